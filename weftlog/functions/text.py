"""Scalar functions on strings: all are built-in expressions and stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log format.
FIELD = r"([A-Za-z_][A-Za-z0-9_]*):(.*?)(?=;[A-Za-z_][A-Za-z0-9_]*:|$)"
REQUEST_LINE = r"(?i)\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(\S+)\s+HTTP/[0-9.]+"
MESSAGE_KEYS = ("raw_log", "msg", "message")
SENSITIVE = r"(?i)(password|passwd|pwd|secret|token|authorization|cookie|session|apikey|api_key|credential)"
# Suffixes with a status: what follows it goes too; and the kind that may hold its text inside, or lack its end.
STATUS_SUFFIX, OPEN_STATUS_SUFFIX = r"\s+\[\d+\](?:\s+.*)?$", r"\s+\[\d+(?:\s+.*)?\]?$"
# End of fixed values.


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, with ``x`` in the expression once however often ``f`` uses it: filters over long chains of columns stay small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(x, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null(x: Column) -> Column:
    return F.when(strip(x) != "", x)


def first_nonempty(*values: Column) -> Column:
    """The first value that is neither null nor blank, stripped; else the empty string."""
    return F.coalesce(*[F.nullif(strip(v.cast("string")), F.lit("")) for v in values], F.lit(""))


def message(line: Column) -> Column:
    """The message of a line: a non-blank field of its JSON envelope, else the line itself."""
    return F.coalesce(*[blank_to_null(F.get_json_object(line, f"$.{k}")) for k in MESSAGE_KEYS], line)


def semicolon_fields(text: Column) -> Column:
    """``key:value;key:value`` as an array of (name, value); escaped slashes and quotes are undone."""
    names = F.regexp_extract_all(text, F.lit(FIELD), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(FIELD), F.lit(2))
    plain = lambda v: strip(F.replace(F.replace(v, F.lit("\\/"), F.lit("/")), F.lit('\\"'), F.lit('"')))
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), plain(v).alias("value")))


def field(fields: Column, name: str) -> Column:
    """The first value of a name; a later one of the same name is ignored. Null if absent."""
    return F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))["value"]


def base64_text(x: Column) -> Column:
    """Decoded text: padding may lack, foreign characters are skipped, bad UTF-8 becomes U+FFFD."""
    clean = F.regexp_replace(F.coalesce(x, F.lit("")), r"[^A-Za-z0-9+/]", "")
    usable = F.when(F.length(clean) % 4 == 1, F.substring(clean, F.lit(1), F.length(clean) - 1)).otherwise(clean)
    padded = F.rpad(usable, (F.ceil(F.length(usable) / 4) * 4).cast("int"), F.lit("="))
    return F.coalesce(F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), F.lit(""))


def request_method(http: Column) -> Column:
    return F.upper(F.regexp_extract(http, REQUEST_LINE, 1))


def request_target(http: Column) -> Column:
    return F.regexp_extract(http, REQUEST_LINE, 2)


def request_body(http: Column) -> Column:
    """What follows the first blank line."""
    return F.regexp_extract(http, r"(?s)^.*?\r?\n\r?\n(.*)$", 1)


def value_type(x: Column) -> Column:
    """The type that a parameter's text looks like; the first test that fits decides."""
    t = strip(F.coalesce(x, F.lit("")))
    low = F.lower(t)
    return (
        F.when(t == "", "EMPTY").when(t.rlike(r"^-?\d+$"), "INT").when(t.rlike(r"^-?\d+\.\d+$"), "FLOAT")
        .when(t.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "UUID").when(low.isin("true", "false"), "BOOL")
        .when(t.startswith("{") & t.endswith("}"), "JSON").when(t.startswith("[") & t.endswith("]"), "ARRAY")
        .when(t.startswith("http://") | t.startswith("https://"), "URL").when(t.contains("@") & t.contains("."), "EMAIL")
        .when((F.length(t) >= 24) & t.rlike(r"^[A-Za-z0-9._~+/=-]+$"), "TOKEN").when(t.contains(","), "LIST").otherwise("STR")
    )


def name_set(pairs: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["name"]))), ",")


def type_pattern(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("=<"), value_type(p["value"]), F.lit(">"))), "&")


def repeated_names(pairs: Column) -> Column:
    names = F.transform(pairs, lambda p: p["name"])
    return F.array_sort(F.filter(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1))


def redact(name: Column, value: Column, most: int = 256) -> Column:
    """Sensitive parameters' values hidden, long ones cut."""
    short = F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("..."))).otherwise(value)
    return F.when(name.rlike(SENSITIVE), "<redacted>").otherwise(short)


def clean_token(x: Column, body: bool = False, status: str = STATUS_SUFFIX) -> Column:
    """A sequence token without its status suffix, action and label, and without its body if asked."""
    t = strip(F.regexp_replace(strip(x), status, ""))
    for cut in (" action=", " label=", *((" BODY ",) if body else ())):
        t = strip(F.substring_index(t, cut, 1))
    return t


def replace_first_field(line: Column, name: str, value: Column) -> Column:
    """The line with the first ``name:...;`` set to a value; unchanged if it has none."""
    pattern = rf"(?s)^(.*?\b{name}:)([^;]*)(;.*)$"
    return F.when(line.rlike(pattern), F.concat(F.regexp_extract(line, pattern, 1), value, F.regexp_extract(line, pattern, 3))).otherwise(line)


def capped_log(count: Column, cap: int) -> Column:
    return F.log(F.least(count, F.lit(cap)) + 1.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def is_object(x: Column) -> Column:
    """Whether a text is one JSON object and nothing else, blanks around it aside.

    Readers of JSON stop behind the first value, so the text is tried inside a list and inside an object.
    """
    one = (F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit('{"a":'), x, F.lit("}"))).isNotNull()
    return F.coalesce(F.ltrim(x).startswith("{") & one, F.lit(False))
