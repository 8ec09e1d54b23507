"""OpenAPI entries, index and merging: nested bodies, bad JSON, nulls, repeats, empty tables."""

import json

from pyspark.sql import functions as F

from weftlog.operators import openapi

DOC = {
    "paths": {
        "/a/{id}": {
            "parameters": [{"name": "x"}],
            "get": {"operationId": "g", "parameters": [{"name": "sessionToken", "in": "query", "required": True, "schema": {"type": "string"}}, "odd", {"in": "query"}]},
            "post": {"summary": "s", "requestBody": {"content": {"application/json": {"schema": {"required": ["o"], "properties": {"o": {"type": "object", "properties": {"status": {"type": "string"}}}, "n": 3}}}}}},
            "put": 4,
        },
        "/b": "odd",
    }
}
BODY = {"parameters": [{"name": "q", "in": "query", "schema": {"type": "string", "format": None}}, {"name": "b", "in": "body", "required": True, "schema": {"type": "array", "enum": ["[]"]}}]}


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "site_id string, doc string")


def test_index(spark):
    found = openapi.index(openapi.entries(docs(spark, ("s", json.dumps(DOC)), ("t", "{bad"), ("u", None), ("v", "[]"), ("w", '{"paths": 3}'))))
    got = {r["api"]: r for r in found.collect()}
    assert set(got) == {"GET /a/{id}", "POST /a/{id}"}
    assert [tuple(p) for p in got["GET /a/{id}"]["parameters"]] == [("sessionToken", "query", True, "string")]
    assert [p["name"] for p in got["GET /a/{id}"]["auth_fields"]] == ["sessionToken"]
    assert [tuple(p) for p in got["POST /a/{id}"]["parameters"]] == [("o", "body", True, "object"), ("o.status", "body", False, "string"), ("n", "body", False, "unknown")]
    assert [p["name"] for p in got["POST /a/{id}"]["sensitive_fields"]] == ["o.status"]
    assert (got["POST /a/{id}"]["summary"], got["POST /a/{id}"]["operation_id"], got["GET /a/{id}"]["operation_id"]) == ("s", "", "g")


def test_merge(spark):
    ddl = "site_id string, path string, key string, value string"
    old = spark.createDataFrame([("s", "/a/{x}", "get", '{"summary":"old"}'), ("s", "/a/{x}", "put", json.dumps(BODY))], ddl)
    new = spark.createDataFrame([("s", "/a/{x}", "get", json.dumps(BODY), 1), ("s", "/a/{x}", "get", '{"summary":"new"}', 2), ("s", "/B", "post", json.dumps(BODY), 1), ("s", "/B", "x-note", '"]["', 1), ("s", "/B", "get", "{bad", 1)], ddl + ", ordinal int")
    got = {(r["path"], r["key"]): r["value"] for r in openapi.merge(old, new).collect()}
    assert json.loads(got["/a/{x}", "get"]) == {"summary": "new", "parameters": []}
    assert json.loads(got["/a/{x}", "put"]) == BODY
    assert json.loads(got["/B", "post"]) == {"parameters": [{"name": "q", "in": "query", "schema": {"type": "string"}}], "requestBody": {"required": True, "content": {"application/json": {"schema": {"type": "object", "properties": {"b": {"type": "array"}}, "required": ["b"]}}}}}
    assert got["/B", "x-note"] == '"]["' and got["/B", "get"] == "{bad"
    items = {r["path"]: r["item"] for r in openapi.path_items(openapi.merge(old, new.filter("value != '{bad'"))).collect()}
    assert set(json.loads(items["/B"])) == {"post", "x-note"} and json.loads(items["/B"])["x-note"] == "]["
    left = openapi.unseen(new.withColumn("path", F.replace("path", F.lit("{x}"), F.lit("{y}"))), old)
    assert {r["path"] for r in left.collect()} == {"/B"}


def test_empty(spark):
    none = openapi.entries(docs(spark))
    assert openapi.index(none).count() == 0
    assert openapi.merge(none, none.selectExpr("*", "1 as ordinal")).count() == 0


def test_documents_of_a_small_file_are_made_by_all_tasks(spark, tmp_path):
    """One file that one task reads: its rows are dealt before documents and scenarios are made of them."""
    from weftlog.plans import queries, reviewed

    row = "id as p_partkey, 'red bolt' as p_name, 'Brand#1' as p_brand, 'LARGE' as p_type, cast(id % 50 as int) as p_size"
    spark.range(200).selectExpr(*row.split(", ")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert spark.read.parquet(f"{tmp_path}/part.parquet").rdd.getNumPartitions() == 1
    for df in (queries.part_documents(spark, str(tmp_path), "p_partkey"), reviewed.rule_reviews(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() == 4 and df.count() == 200
