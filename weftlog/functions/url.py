"""URLs, paths and query strings, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlog.functions.text import let, strip

# Static suffixes and health checks.
STATIC_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".css", ".js", ".txt", ".xml", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".map", ".bmp", ".webp", ".mp4")
HEALTH_PATHS = ("", "/", "/health", "/healthz")
HEALTH_PREFIXES = ("/health/", "/healthz/")
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
HEX = r"^[0-9a-fA-F]{8,}$"
INTEGER, ISSUE_KEY, DATE, TOKEN = r"^-?\d+$", r"^[A-Za-z][A-Za-z0-9]+-\d+$", r"^\d{4}-\d{2}-\d{2}$", r"^[A-Za-z0-9_-]{24,}$"
# End of fixed values.


def percent_decode(x: Column) -> Column:
    """Percent-decoding that keeps ``+`` and malformed escapes, and reads bad UTF-8 as U+FFFD."""

    def decoded(text: Column) -> Column:
        whole = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
        plain = F.make_valid_utf8(F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))))
        return F.when(text.contains("%"), F.coalesce(plain, text)).otherwise(text)

    return let(x, decoded)


def clean_target(x: Column) -> Column:
    return F.regexp_replace(F.replace(strip(x), F.lit("\\/"), F.lit("/")), r'^"+|"+$', "")


def raw_path(url: Column) -> Column:
    """Path of an absolute or relative URL: no scheme, host, query, fragment or last ``;parameters``."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    bare = F.regexp_replace(bare, r"^//[^/]*", "")
    return F.regexp_replace(bare, r";[^/]*$", "")


def target_path(target: Column) -> Column:
    """Path of a request's target: one that begins with a slash is a path as a whole, ``//a/b`` too; others may be URLs."""
    bare = F.regexp_replace(F.regexp_replace(target, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return F.regexp_replace(bare, r";[^/]*$", "")


def raw_query(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"#.*$", ""), r"\?(.*)$", 1)


def query_pairs(query: Column) -> Column:
    """``a=1&b=2`` as an array of (name, value): ``+`` is a space, a key without ``=`` has an empty value."""
    part = lambda s: percent_decode(F.replace(s, F.lit("+"), F.lit(" ")))
    pieces = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda s: s != "")
    return F.transform(pieces, lambda s: F.struct(part(F.substring_index(s, "=", 1)).alias("name"), F.when(s.contains("="), part(F.regexp_replace(s, r"^[^=]*=", ""))).otherwise("").alias("value")))


def segment_template(part: Column, keep_braces: bool = False, file_hash: bool = True) -> Column:
    stem, suffix = F.regexp_extract(part, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(part, r"^(.*)\.([^.]*)$", 2)
    case = (
        F.when(part.rlike(UUID), "{uuid}").when(part.rlike(INTEGER), "{int}").when(part.rlike(ISSUE_KEY), "{issue_key}")
        .when(part.rlike(HEX), "{hex}").when(part.rlike(DATE), "{date}").when(part.rlike(TOKEN), "{token}")
    )
    if keep_braces:
        case = F.when(part.rlike(r"^\{.*\}$"), part).otherwise(case)
        return F.coalesce(case, F.lower(part))
    if file_hash:
        case = case.when(stem.rlike(HEX), F.concat(F.lit("{file_hash}."), F.lower(suffix)))
    return case.otherwise(F.lower(part))


def path_template(path: Column, keep_braces: bool = False, file_hash: bool = True) -> Column:
    """A path with identifier-like segments replaced by placeholders, the rest in lower case."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    shaped = F.transform(parts, lambda p: segment_template(percent_decode(p), keep_braces, file_hash))
    return F.concat(F.lit("/"), F.array_join(shaped, "/"))


def path_class(path: Column) -> Column:
    def named(p: Column) -> Column:
        static, health = F.lit(False), p.isin(*HEALTH_PATHS)
        for suffix in STATIC_SUFFIXES:
            static = static | F.lower(p).endswith(suffix)
        for prefix in HEALTH_PREFIXES:
            health = health | p.startswith(prefix)
        return F.when(static, "static_resource").when(health, "health_check").otherwise("dynamic_request")

    return let(path, named)


def join_query(path: Column, query: Column) -> Column:
    return F.when(F.coalesce(query, F.lit("")) != "", F.concat_ws("?", path, query)).otherwise(path)


def openapi_template(path: Column) -> Column:
    """Placeholders named once each: the second ``{int}`` becomes ``{int_2}`` and so on."""
    parts = F.filter(F.split(path_template(path, keep_braces=True), "/"), lambda p: p != "")
    nth = lambda p, i: F.size(F.filter(F.slice(parts, 1, i + 1), lambda q: q == p))
    named = F.transform(parts, lambda p, i: F.when(p.rlike(r"^\{.*\}$") & (nth(p, i) > 1), F.concat(F.regexp_replace(p, r"\}$", ""), F.lit("_"), nth(p, i).cast("string"), F.lit("}"))).otherwise(p))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def path_fingerprint(path: Column) -> Column:
    """A path's shape: lower case, every placeholder ``{}``."""
    return F.regexp_replace(F.lower(path), r"\{[^}]*\}", "{}")


def path_bindings(template: Column, path: Column) -> Column:
    """(name, value) of each placeholder where template and path have equally many segments; else none."""
    t, p = F.filter(F.split(template, "/"), lambda x: x != ""), F.filter(F.split(path, "/"), lambda x: x != "")
    both = F.zip_with(t, p, lambda a, b: F.struct(F.regexp_extract(a, r"^\{(.*)\}$", 1).alias("name"), b.alias("value")))
    return F.when(F.size(t) == F.size(p), F.filter(both, lambda x: x["name"] != "")).otherwise(F.filter(both, lambda x: F.lit(False)))


def request_method(token: Column) -> Column:
    return F.upper(F.regexp_extract(token, r"^\s*([A-Za-z]+)\s+\S", 1))


def request_target(token: Column) -> Column:
    return F.regexp_extract(token, r"^\s*[A-Za-z]+\s+(\S+)", 1)


def request_api(token: Column) -> Column:
    """``METHOD path`` of a token, path decoded, query and body dropped; a token of another shape as it is."""
    known = token.rlike(r"(?i)^\s*(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+\S")
    return F.when(known, F.concat_ws(" ", request_method(token), percent_decode(target_path(request_target(token))))).otherwise(strip(token))
