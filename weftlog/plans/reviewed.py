"""Queries over documented APIs and rules: pages as documents and calls, parts as reviewed scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions import url as u
from weftlog.operators import apidocs, openapi, reviews, rules
from weftlog.plans.queries import dealt, page_requests, table


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented APIs of all pages, site by site: api and place, its first page."""
    p = page_requests(spark, sf_dir)
    method = F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET")
    return p.groupBy(F.concat_ws(" ", method, u.openapi_template(F.col("full_path"))).alias("api")).agg(F.min("page_id").alias("place"))


def page_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as calls with concrete ids: with a slash at the end, in lower case, without a method, as an ending, or of a longer path."""
    way, path = F.col("page_id") % 6, F.col("full_path")
    call = (
        F.when(way == 0, F.concat(F.lit("get "), path, F.lit("/"))).when(way == 1, F.concat(F.lit(" POST "), path)).when(way == 2, path)
        .when(way == 3, F.concat(F.lit("GET "), F.regexp_replace(path, r"^/[^/]*", ""))).when(way == 4, F.concat(F.lit("GET /v2"), u.openapi_template(path))).otherwise(F.concat(F.lit("PUT "), path))
    )
    return page_requests(spark, sf_dir).select(call.alias("api"))


def documented_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apidocs.documented(page_calls(spark, sf_dir), page_documents(spark, sf_dir), place="place")
    return found.select("api", F.coalesce("doc_api", F.lit("")).alias("doc_api"), F.coalesce("place", F.lit(-1)).alias("place"))


def part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of documented APIs named from parts: one for each pair of words of their names."""
    w0, w1 = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    d = table(spark, sf_dir, "part").groupBy(w0.alias("w0"), w1.alias("w1")).agg(F.min("p_partkey").alias("place"))
    field = lambda n: F.struct(n.alias("name"), F.lit("query").alias("in"), F.lit(False).alias("required"), F.lit("string").alias("type"))
    id_, status, token = F.lit("partId"), F.concat("w0", F.lit("Status")), F.lit("token")
    return d.select(
        F.format_string("POST /%s/{partId}/%s", "w0", "w1").alias("api"), F.concat_ws(" ", "w0", "w1").alias("summary"), F.array(field(id_), field(status), field(token)).alias("parameters"),
        F.array(field(id_)).alias("object_parameters"), F.array(field(status)).alias("sensitive_fields"), F.when(F.length("w1") % 2 == 0, F.array(field(token))).otherwise(F.array().cast("array<struct<name:string,`in`:string,required:boolean,type:string>>")).alias("auth_fields"), "place",
    )


def rule_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a reviewed scenario; size and key decide which blocks it has and what they leave open."""
    size, key = F.col("p_size").cast("int"), F.col("p_partkey")
    w0, w1 = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    none = F.lit(None).cast("string")
    call, listing = F.concat(F.lit("post /"), w0, F.lit("/"), key.cast("string"), F.lit("/"), w1), F.concat(F.lit("GET /list/"), (size % 5).cast("string"))
    a = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]).cast("array<string>")
    pick = lambda of, *x: F.element_at(F.array(*x), (of % len(x) + 1).cast("int"))
    every = lambda n, then, other: F.when(size % n == 0, then).otherwise(other)
    sequence = F.struct(
        pick(size, a(), a(listing, call), a("GET /list", " ", call), a(call)), pick(size, a(call, "GET /list", call), a(call), a()), F.lit("listed first"),
        F.when(size % 5 == 0, F.concat(F.lit("skips "), listing)).when(size % 5 == 1, "无法确定"), none, a(),
    )
    parameter = F.struct(
        every(2, a("orderId", F.concat(w1, F.lit("Key"))), every(7, a("none"), a())), every(6, a("POST /pay"), a()), every(10, a("GET /cart"), a()), F.when(size % 8 == 0, "unknown").when(size % 8 == 1, "derived_from_context_api"),
        F.when(size % 9 == 0, "unknown"), F.when(size % 11 == 0, "orderId 来源 不明").when(size % 3 == 1, "none"), a(), F.lit(None).cast(f"array<{reviews.OCCURRENCE_DDL}>"), F.lit(None).cast(f"array<{reviews.BINDING_DDL}>"),
    )
    title = F.concat("p_name", F.when(key % 17 == 0, ' "x\\y"').otherwise(""))
    angles = F.when(size % 3 == 0, F.array(F.struct(F.lit("angle"), none, a(call), a("ownerRole", "itemId")))).cast(f"array<{reviews.ANGLE_DDL}>")
    scenario = F.struct(
        F.when(key % 19 == 0, F.concat(F.lit("own-"), key.cast("string"))), F.when(key % 23 == 0, " ").otherwise(title), pick(key, F.lit("BOLA"), F.lit("功能级越权"), none, F.lit("BOPLA"), F.lit("AUTH_BYPASS")), pick(key, F.lit("high"), none),
        pick(key, F.lit("sequence_order"), F.lit("parameter_consistency"), F.lit("both"), none), sequence, parameter, F.when(key % 29 == 0, none).otherwise(F.concat(F.lit("order of "), "p_name")), none,
        F.lit(0.5), *[F.lit("login area") if c == "target_asset" else none for c in reviews.DETAILS], angles,
    )
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(key.cast("int").alias("cluster_index"), (size % 13 > 0).alias("is_trustworthy"), (size / 50.0).alias("trust_score"), F.col("p_brand").alias("business_pattern_name"), a().alias("mixed_member_session_ids"), F.array(scenario).cast(f"array<{reviews.SCENARIO_DDL}>").alias("possible_security_scenarios"))


def joined(c: Column | str, f=lambda x: x) -> Column:
    return F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))


def review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from the reviewed parts, with documents looked up, names bound, scopes filled in and formulas written out."""
    made = rules.generate(rule_reviews(spark, sf_dir), part_index(spark, sf_dir), place="place")
    p = F.get(F.filter("logic_expressions", lambda e: e["scope"]["parameter"].isNotNull()), F.lit(0))["scope"]["parameter"]
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    return made.select(
        "fol_id", "status", joined("missing_requirements").alias("missing"), joined("related_apis").alias("related"), joined("openapi_summary", lambda x: x["api"]).alias("documents"), F.col("source.security_type").alias("security_type"),
        *[F.col(f"formula_bindings.{c}").alias(c) for c in ("api", "target_asset", "risk_level", "risk_type", "object_field", "sensitive_field", "auth_field")],
        joined("activity_abstraction.activities", lambda x: F.concat_ws("=", x["symbol"], x["label"])).alias("activities"), F.col("activity_abstraction.missing_or_reordered_label").alias("missing_label"),
        F.array_join(F.transform("logic_expressions", lambda e: e["formula"]), " | ").alias("formulas"),
        joined(p["target_api_scope"]).alias("targets"), joined(p["context_api_scope"]).alias("contexts"), text(p["dependency_relation"], "relation"), text(p["expected_source"], "expected_source"), joined(p["normal_parameter_sequence"]).alias("normal_order"),
        joined(p["parameter_occurrences"], lambda r: F.concat_ws("@", r["parameter"], r["api"], r["role"])).alias("occurrences"), joined(p["context_binding"], lambda r: F.concat_ws(">", r["source_api"], r["target_api"], r["parameter"])).alias("bindings"),
    )


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer, of six shapes: parameters alone, several media types, nested bodies, neither, odd entries, and no JSON."""
    key = F.col("c_custkey").cast("string")
    nested = F.format_string('{"type":"object","required":["user","n%1$s"],"properties":{"user":{"type":"object","required":["ownerId"],"properties":{"ownerId":{"type":"string"},"role":{"properties":{"level":{"type":"integer"}}}}},"n%1$s":{"type":"number"},"plain":{}}}', key)
    op = F.element_at(F.array(
        F.format_string('{"summary":"s%1$s","operationId":"o%1$s","parameters":[{"name":"id%1$s","in":"path","required":true,"schema":{"type":"integer"}},{"in":"query"},{"name":"token","in":"header"}]}', key),
        F.format_string('{"parameters":[],"requestBody":{"content":{"application/json":{"schema":%s},"text/x-form":{"schema":{"properties":{"status":{"type":"string"}}}},"a/b":{}}}}', nested),
        F.format_string('{"requestBody":{"required":true,"content":{"application/json":{"schema":%s}}}}', nested), F.lit('{"summary":"none"}'), F.lit('{"parameters":{"name":"x"},"requestBody":{"content":[1]}}'), F.lit('"no object"')), (F.col("c_custkey") % 6 + 1).cast("int"))
    method = F.element_at(F.array(*[F.lit(x) for x in ("get", "POST", "x-note", "delete")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    doc = F.format_string('{"paths":{"/c/%1$s/{id}":{"%2$s":%3$s,"parameters":[]},"/odd":[1]}}', key, method, op)
    return dealt(table(spark, sf_dir, "customer"), "c_custkey").select(F.concat(F.lit("s"), (F.col("c_custkey") % 5).cast("string")).alias("site_id"), F.when(F.col("c_custkey") % 11 == 0, F.substring(doc, F.lit(1), F.length(doc) - 1)).otherwise(doc).alias("doc"))


def openapi_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of these documents: every parameter and body field with its place, need and type."""
    found = openapi.index(openapi.entries(customer_documents(spark, sf_dir)))
    shown = lambda p: F.concat_ws(":", p["name"], p["in"], p["required"].cast("string"), p["type"])
    return found.select("site_id", "api", "summary", "operation_id", joined("parameters", shown).alias("parameters"), *[joined(c, lambda p: p["name"]).alias(c) for c in ("object_parameters", "sensitive_fields", "auth_fields")])


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated rules as lines of a report."""
    return rules.markdown(rules.generate(rule_reviews(spark, sf_dir), part_index(spark, sf_dir), place="place"))


QUERIES = (rule_lines, openapi_shapes, documented_calls, review_rules)
