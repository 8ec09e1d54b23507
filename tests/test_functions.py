"""Table-driven cases of the scalar operators, quirks included."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlog.functions import params, text, times, url


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("value", "kind"), [
    ("", "EMPTY"), ("  ", "EMPTY"), ("-12", "INT"), ("1.5", "FLOAT"), ("123e4567-e89b-12d3-a456-426614174000", "UUID"), ("TRUE", "BOOL"), ('{"a":1}', "JSON"), ("[1]", "ARRAY"),
    ("https://a.b", "URL"), ("a@b.c", "EMAIL"), ("a" * 24, "TOKEN"), ("a,b", "LIST"), ("abc", "STR"), (None, "EMPTY"),
])
def test_value_type(spark, value, kind):
    assert one(spark, text.value_type, value) == kind


@pytest.mark.parametrize(("path", "want"), [
    ("/app/12/Issue", "/app/{int}/issue"), ("/a/ABC-12", "/a/{issue_key}"), ("/a/deadbeef01", "/a/{hex}"), ("/a/2024-01-02", "/a/{date}"), ("/a/" + "x" * 24, "/a/{token}"),
    ("/a/deadbeef01.PNG", "/a/{file_hash}.png"), ("/a/12345678", "/a/{int}"), ("", "/"), ("/a/%41", "/a/a"),
])
def test_path_template(spark, path, want):
    assert one(spark, url.path_template, path) == want


@pytest.mark.parametrize(("value", "want"), [("a+b%20c", "a+b c"), ("%zz%41", "%zzA"), ("100%", "100%"), ("plain", "plain"), (None, None), ("%C3%A9", "é")])
def test_percent_decode(spark, value, want):
    assert one(spark, url.percent_decode, value) == want


@pytest.mark.parametrize(("query", "want"), [("a=1&b=x+y&c", [("a", "1"), ("b", "x y"), ("c", "")]), ("a=b=c&&d=%26", [("a", "b=c"), ("d", "&")]), ("", []), (None, [])])
def test_query_pairs(spark, query, want):
    assert [tuple(p) for p in one(spark, url.query_pairs, query)] == want


@pytest.mark.parametrize(("value", "want"), [("R0VUIC8=", "GET /"), ("R0VUIC8", "GET /"), ("R0VU IC8=\n", "GET /"), ("/w==", "�"), ("", ""), (None, "")])
def test_base64(spark, value, want):
    assert one(spark, text.base64_text, value) == want


def test_semicolon_fields_first_wins(spark):
    fields = lambda x: text.semicolon_fields(x)
    line = r'tag:t;url:\/a\/b?x=1;y;method:GET;method:POST'
    got = {}
    for f in one(spark, fields, line):
        got.setdefault(f.name, f.value)
    assert got == {"tag": "t", "url": "/a/b?x=1;y", "method": "GET"}
    assert one(spark, lambda x: text.field(fields(x), "method"), line) == "GET"
    assert one(spark, lambda x: text.field(fields(x), "none"), line) is None


@pytest.mark.parametrize(("dialect", "want"), [
    (params.EVENT, [("a.b", "1"), ("c[]", "True"), ("c[]", ""), ("d", "1.0")]),
    (params.BOUNDARY, [("a.b", "1"), ("c[0]", "True"), ("d", "1.0")]),
    (params.DETECTION, [("a.b", "1"), ("c[0]", "True"), ("c[1]", "None"), ("d", "1.0")]),
    (params.PROFILE, [("a.b", "1"), ("c[]", "True"), ("c[]", ""), ("d", "1.0"), ("e", "[]")]),
])
def test_json_dialects(spark, dialect, want):
    body = '{"a": {"b": 1}, "c": [true, null], "d": 1.0, "e": []}'
    assert [tuple(p) for p in one(spark, lambda x: params.body_pairs(x, dialect), body)] == want


def test_other_bodies(spark):
    assert [tuple(p) for p in one(spark, params.body_pairs, " a=1&b=2 ")] == [("a", "1"), ("b", "2")]
    for body in ("{bad", "text", "", None):
        assert one(spark, params.body_pairs, body) == []


@pytest.mark.parametrize(("value", "us"), [
    ("2024-01-01T00:00:00Z", 1704067200000000), ("2024-01-01T08:00:00+08:00", 1704067200000000), ("2024-01-01T08:00:00", 1704067200000000), ("2023-12-31T24:00:00+00:00", 1704067200000000),
    ("2024-01-01T:30:00Z", 1704069000000000), ("bad", None), ("", None), (None, None),
])
def test_iso_time(spark, value, us):
    assert one(spark, lambda x: F.unix_micros(times.iso_time(x)), value) == us


@pytest.mark.parametrize(("value", "us"), [("2024-01-01 08:00:00", 1704067200000000), ("2024-01-01 08:00:00.500 tail", 1704067200500000), ("x", None)])
def test_log_time(spark, value, us):
    assert one(spark, lambda x: F.unix_micros(times.log_time(x)), value) == us


def test_small_helpers(spark):
    assert one(spark, lambda x: text.clean_token(x, True), "GET /a [200] BODY x=1") in ("GET /a [200]", "GET /a")
    assert one(spark, text.clean_token, "GET /a [200]") == "GET /a"
    assert one(spark, lambda x: text.replace_first_field(x, "event_type", F.lit("sqli")), "a:1;event_type:none;event_type:x;") == "a:1;event_type:sqli;event_type:x;"
    assert one(spark, lambda x: text.redact(F.lit("password"), x), "p") == "<redacted>"
    assert len(one(spark, lambda x: text.redact(F.lit("q"), x), "p" * 300)) == 256
    assert one(spark, url.openapi_template, "/a/1/b/2") == "/a/{int}/b/{int_2}"
    assert one(spark, url.path_class, "/x/a.PNG") == "static_resource"
    assert one(spark, url.path_class, "/healthz/live") == "health_check"
    assert [tuple(b) for b in one(spark, lambda x: url.path_bindings(F.lit("/a/{id}"), x), "/a/7")] == [("id", "7")]
    assert one(spark, lambda x: url.path_bindings(F.lit("/a/{id}"), x), "/a/7/8") == []
    assert one(spark, url.request_api, "get /a/%41?x=1 [200]") == "GET /a/A"


def test_repeated_bodies_are_read_once(monkeypatch):
    """Texts that repeat in a batch are parsed once; nulls and bad texts stay null, empty lists stay empty."""
    read = []

    def parts(text):
        read.append(text)
        return None if text == "bad" else [(c, c.upper()) for c in text]

    texts = pa.array(["ab", None, "bad", "", "ab", "c"] * 50 + ["ab"])
    got = params.lists(texts, parts, [("name", pa.string()), ("value", pa.string())]).to_pylist()
    pair = lambda s: [{"name": c, "value": c.upper()} for c in s]
    assert got == [pair("ab"), None, None, [], pair("ab"), pair("c")] * 50 + [pair("ab")]
    assert sorted(read) == ["", "ab", "bad", "c"]
    assert params.lists(texts[:0], parts, [("name", pa.string()), ("value", pa.string())]).to_pylist() == []
