"""OpenAPI documents as long tables: entries of path items, their index, and the merging of fragments.

An entry is site_id, path, key (a method, or another key of a path item) and value (its JSON). A document of
any size is rows, and merging is a union with the last row of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions.openapi import FIELD, METHODS, body_fields, normal_operation
from weftlog.functions.url import path_fingerprint

# What names of objects, of sensitive fields and of fields of a login have in them.
OBJECT = r"(?i)(issue|project|space|content|page|comment|worklog|attachment|board|sprint|filter|dashboard|avatar|user|group|id|key)"
SENSITIVE = r"(?i)(reporter|creator|author|assignee|owner|status|resolution|security|visibility|role|permission|sprint|version|duedate|project|issuetype|transition)"
AUTH = r"(?i)(login|auth|session|cookie|token|xsrf|csrf|secure)"
# End of fixed values.

OPERATION = "summary string, operationId string, parameters string, requestBody string"


def entries(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Entries of documents (site_id and the JSON text); bad JSON, and paths that are no objects, have none."""
    paths = F.from_json(F.get_json_object(doc, "$.paths"), "map<string,string>")
    items = docs.select("site_id", F.explode(paths).alias("path", "item"))
    return items.select("site_id", "path", F.explode(F.from_json("item", "map<string,string>")).alias("key", "value"))


def index(entry: DataFrame) -> DataFrame:
    """site_id, api, summary, operation_id, parameters and those of them that name objects, sensitive fields and a login.

    One row per entry that is an operation. Parameters come as listed, then the fields of each body; those without a name are left out.
    """
    op = entry.filter(F.lower("key").isin(*METHODS) & F.trim("value").startswith("{")).withColumn("o", F.from_json("value", OPERATION))
    given = F.transform(F.from_json("o.parameters", "array<string>"), lambda x: F.from_json(x, "name string, in string, required string, schema string"))
    listed = F.transform(F.filter(given, lambda p: F.coalesce(p["name"], F.lit("")) != ""), lambda p: F.struct(
        p["name"].alias("name"), F.coalesce(p["in"], F.lit("")).alias("in"), F.coalesce(p["required"].try_cast("boolean"), F.lit(False)).alias("required"), F.coalesce(F.get_json_object(p["schema"], "$.type"), F.lit("unknown")).alias("type")))
    media = F.map_values(F.from_json(F.get_json_object("o.requestBody", "$.content"), "map<string,string>"))
    # one row per media type goes through Python and comes back by position
    bodies = op.select("site_id", "path", "key", "o", listed.alias("listed"), F.posexplode_outer(F.transform(media, lambda m: F.get_json_object(m, "$.schema"))).alias("pos", "schema"))
    bodies = bodies.withColumn("fields", body_fields(F.col("schema")))
    by = ["site_id", "path", "key"]
    whole = bodies.groupBy(*by).agg(F.first("o").alias("o"), F.first("listed").alias("listed"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fields"))), lambda x: x["fields"])).alias("fields"))
    none = F.array().cast(f"array<{FIELD}>")
    whole = whole.withColumn("parameters", F.concat(F.coalesce(F.col("listed").cast(f"array<{FIELD}>"), none), F.filter("fields", lambda p: p["name"] != "")))
    tagged = lambda pattern: F.filter("parameters", lambda p: p["name"].rlike(pattern))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return whole.select(
        "site_id", F.concat_ws(" ", F.upper("key"), "path").alias("api"), text("o.summary").alias("summary"), text("o.operationId").alias("operation_id"),
        "parameters", tagged(OBJECT).alias("object_parameters"), tagged(SENSITIVE).alias("sensitive_fields"), tagged(AUTH).alias("auth_fields"),
    )


def unseen(fragments: DataFrame, existing: DataFrame) -> DataFrame:
    """``fragments`` whose path, or another of its shape, the site's existing entries lack."""
    shape = path_fingerprint(F.col("path"))
    return fragments.withColumn("__shape", shape).join(existing.select("site_id", shape.alias("__shape")).distinct(), ["site_id", "__shape"], "left_anti").drop("__shape")


def merge(existing: DataFrame, fragments: DataFrame, order: str = "ordinal") -> DataFrame:
    """Entries of the merged documents: a fragment's entry replaces the one of its path and key, the last by ``order`` wins.

    Body parameters of fragments become request bodies; entries there before stay as they are.
    """
    new = fragments.withColumn("value", F.when(F.lower("key").isin(*METHODS), normal_operation(F.col("value"))).otherwise(F.col("value")))
    both = existing.select("site_id", "path", "key", "value", F.lit(0).alias("__new"), F.lit(None).cast("bigint").alias("__at"))
    both = both.union(new.select("site_id", "path", "key", "value", F.lit(1).alias("__new"), F.col(order).cast("bigint").alias("__at")))
    return both.groupBy("site_id", "path", "key").agg(F.max(F.struct("__new", "__at", "value"))["value"].alias("value"))


def json_object(pairs: Column) -> Column:
    """The JSON text of (key, value) pairs, values being JSON."""
    def quoted(c: Column) -> Column:
        listed = F.to_json(F.array(c))
        return listed.substr(F.lit(2), F.length(listed) - 2)

    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))


def path_items(entry: DataFrame) -> DataFrame:
    """site_id, path and item (JSON): a row per path, to be written by site."""
    return entry.groupBy("site_id", "path").agg(json_object(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("item"))
