"""Calls against documented APIs.

A call finds a document if the paths are equal, if they are once ids are generalised, or if one path ends in
the other; of all it finds the first ones count, in the documents' order. Each way is an equality of keys: a
documented path gives its shape, itself and all its endings, a call its shape, itself and its endings from
each slash on. Of the documents that share a key only the first ones can count, so the documents' side keeps
these, and no key brings all paths that end alike together. Calls that share a key (all concrete ids of one
shape) are dealt out over copies of the documents' few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Methods, ids in the paths of calls, and placeholders in documented ones.
METHOD = r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+"
CALL_IDS = r"/\d+|/[A-Fa-f0-9-]{8,}"
PLACEHOLDER = r"\{[^/]+\}"
# End of fixed values.

#: Copies of a document's keys, over which the calls of one key are dealt.
DEALT = 16


def normal_api(api: Column) -> Column:
    """``METHOD path`` with the method in upper case; other text as it is, trimmed."""
    t = F.regexp_replace(api, r"^\s+|\s+$", "")
    return F.when(t.rlike(METHOD), F.concat_ws(" ", F.upper(F.regexp_extract(t, r"^(\S+)", 1)), F.regexp_extract(t, r"(?s)^\S+\s+(.*)$", 1))).otherwise(t)


def method_of(api: Column) -> Column:
    """What stands before the first space; empty if there is none."""
    return F.regexp_extract(api, r"^(\S+)\s+\S", 1)


def path_of(api: Column) -> Column:
    """What stands behind the method, without slashes at the end."""
    return F.regexp_replace(F.when(method_of(api) != "", F.regexp_replace(api, r"^\S+\s+", "")).otherwise(api), r"/+$", "")


def keys(path: Column, shape: Column, endings: Column, whole: str, parts: str) -> Column:
    """(kind, key) of one side: its shape, itself as ``whole`` and its endings as ``parts``."""
    one = lambda kind, key: F.struct(F.lit(kind), key).cast("struct<kind:string,key:string>")
    return F.concat(F.array(one("shape", shape), one(whole, path)), F.transform(endings, lambda e: one(parts, e)))


def documented_keys(index: DataFrame, by: list[str], place: str | None, most: int) -> DataFrame:
    """``by``, method, kind, key, dealt, doc_api and place: of each key the first ``most`` documents."""
    d = index.select(*by, F.col("api").alias("doc_api"), (F.col(place) if place else F.col("api")).alias("place"))
    d = d.withColumns({"doc": normal_api(F.col("doc_api"))}).filter("doc != ''").withColumns({"own_method": method_of(F.col("doc")), "path": path_of(F.col("doc"))})
    endings = F.transform(F.sequence(F.lit(1), F.length("path") + 1), lambda i: F.col("path").substr(i, F.length("path")))
    # a call without a method meets all methods
    d = d.select(*by, "doc_api", "place", F.explode(F.array_distinct(F.array("own_method", F.lit("")))).alias("method"), F.explode(keys(F.col("path"), F.regexp_replace("path", PLACEHOLDER, "{}"), endings, "end", "start")).alias("k"))
    d = d.select(*by, "doc_api", "place", "method", "k.kind", "k.key")
    first = F.row_number().over(Window.partitionBy(*by, "method", "kind", "key").orderBy(F.col("place").asc_nulls_last(), "doc_api"))
    d = d.withColumn("n", first).filter(F.col("n") <= most)
    dealt = F.when(F.col("kind") == "start", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(DEALT - 1)))
    return d.select(*by, "method", "kind", "key", F.explode(dealt).alias("dealt"), "doc_api", "place")


def documented(apis: DataFrame, index: DataFrame, by: list[str] | None = None, place: str | None = None, most: int = 2) -> DataFrame:
    """Up to ``most`` documents for each distinct API of ``apis`` (``by`` and api): ``by``, api, doc_api, place; nulls if there is none.

    ``index`` has ``by``, api and, if named, ``place``, the documents' order; else they are in order of their names.
    An API with a method meets documents of that method only. Slashes at the end do not count, and a path without
    anything else meets every document. Endings of calls begin at a slash, as documented paths do. Null and blank APIs
    find nothing; repeated documents count once.
    """
    by = by or []
    a = apis.select(*by, "api").distinct().withColumn("call", normal_api(F.coalesce("api", F.lit(""))))
    a = a.withColumns({"method": method_of(F.col("call")), "path": path_of(F.col("call"))})
    parts = F.split("path", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i == F.size(parts), F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))))
    k = a.filter("call != ''").select(*by, "api", "method", F.explode(F.array_distinct(keys(F.col("path"), F.regexp_replace("path", CALL_IDS, "/{}"), endings, "start", "end"))).alias("k"))
    k = k.select(*by, "api", "method", "k.kind", "k.key", F.when(F.col("k.kind") == "start", 0).otherwise(F.pmod(F.xxhash64("api"), F.lit(DEALT))).cast("int").alias("dealt"))
    found = k.join(documented_keys(index.distinct(), by, place, most), [*by, "method", "kind", "key", "dealt"])
    # at most `most` for each key of a call
    best = found.groupBy(*by, "api").agg(F.slice(F.array_sort(F.collect_set(F.struct("place", "doc_api"))), 1, most).alias("found"))
    best = best.withColumnsRenamed({c: f"__{c}" for c in (*by, "api")})
    out = a.join(best, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("api", *by)], "left")
    return out.select(*by, "api", F.explode_outer("found").alias("d")).select(*by, "api", "d.doc_api", "d.place")


def context(apis: DataFrame, entries: DataFrame, by: list[str] | None = None, place: str | None = None, most: int = 2) -> DataFrame:
    """Entries of the documents found for each API: ``by``, api, place and ``entry``; an API without one gets an entry of its own name.

    ``entries`` is an index as ``openapi.index`` makes it, one row per ``by`` and api.
    """
    by = by or []
    found = documented(apis, entries.select(*by, "api", *([place] if place else [])), by, place, most)
    names = lambda c: F.coalesce(F.transform(c, lambda p: p["name"]), F.array().cast("array<string>")).alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    e = entries.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("api").alias("__api"), text("summary"), *[names(c) for c in ("parameters", "object_parameters", "sensitive_fields", "auth_fields")])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    joined = found.join(e, [F.col("doc_api") == F.col("__api"), *same], "left")
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("parameters", "object_parameters", "sensitive_fields", "auth_fields")]
    return joined.select(*by, "api", "place", F.struct(F.coalesce("doc_api", "api").alias("api"), text("summary"), F.slice(lists[0], 1, 20).alias("parameters"), *lists[1:]).alias("entry"))
