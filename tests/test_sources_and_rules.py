"""Traces, session objects and files, documented APIs and generated rules against plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from weftlog.functions import text as t
from weftlog.functions import times
from weftlog.functions import url as u
from weftlog.operators import apidocs, events, reviews, rules, sessions
from weftlog.sources import readers


def naive_trace(text, site):
    """Line by line: a header ends a session, other lines that are no step do not count."""
    found, name, n, step = [], "", 0, 0
    for line in text.split("\n"):
        line = line.strip()
        head = re.match(r"^===\s+(.*?)\s*===", line)
        if head:
            name, n, step = head[1].replace(" ", "_"), n + 1, 0
        elif body := re.match(r"^Step\s+\d+:\s+(.+)$", line):
            token = re.sub(r"\s+\[\d+\](?:\s+.*)?$", "", body[1]).strip()
            if token:
                step += 1
                found.append((name or f"{site}_txt_{n}", step, token))
    return found


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_traces_equal_line_loop(spark, tmp_path, split):
    """Files with blank lines, without a first header, with empty and repeated headers, cut into few or many splits."""
    rng = random.Random(int(split[:2]))
    kinds = ["", "  ", "noise", "=== Session sess_{n} Label:abnormal Length:9 ===", "=== x ===  tail", "===  ===", "Step 3: GET /a/{n}", "Step 12:  POST /b/{n} [200] ok", "  Step 4: GET /c [404]", "Step 5: \tGET /d/{n}", "step 5: no"]
    texts = {name: "\n".join(rng.choice(kinds).format(n=rng.randint(0, 99)) for _ in range(n)) + end for name, n, end in (("a_site_7_x", 300, "\n"), ("b_site_8", 77, ""), ("site_9", 1, "\n"), ("site_10", 40, "\n\n"))}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = readers.trace_steps(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(f"{name}.txt", *row) for name, text in texts.items() for row in naive_trace(text, re.search(r"site_(\d+)", name)[1])]
    assert sorted((r["file"].split("/")[-1], r["session_id"], r["step"], r["token"]) for r in got) == sorted(want)
    assert {r["session_name"] for r in got if r["session_id"].startswith("Session")} <= {f"sess_{i}" for i in range(100)}


def test_session_objects(spark, tmp_path):
    rows = [
        {"session_id": "full", "site_id": "1", "full_api_sequence": ["GET /a?x=1", "  ", "POST /b"], "api_sequence": ["no"]},
        {"session_id": "short", "source_ip": "", "client_key": "c", "full_api_sequence": [], "api_sequence": [" GET //x/y [200] "]},
        {"session_id": "map", "sequence": {"10": {"token": "GET /t"}, "2": {"full_api_request": "GET /f", "token": "no"}, "3": {"api_request_pattern": "GET /p"}, "4": {}, "5": {"token": " "}}},
        {"session_id": "none"},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"a": 1} {"session_id": "two"}\n')
    got = readers.session_steps(readers.json_blocks(spark, str(tmp_path / "s.jsonl"))).collect()
    assert sorted((r["session_id"], r["step"], r["token"]) for r in got) == [("full", 1, "GET /a?x=1"), ("full", 2, "POST /b"), ("map", 1, "GET /f"), ("map", 2, "GET /p"), ("map", 3, "GET /t"), ("short", 1, "GET //x/y [200]")]
    by = {(r["session_id"], r["step"]): r for r in got}
    assert (by["full", 1]["api"], by["full", 1]["site_id"], by["short", 1]["source_ip"], by["short", 1]["site_id"], by["short", 1]["api"]) == ("GET /a", "1", "c", "unknown_site", "GET //x/y")


def test_files_by_site_and_bucket(spark, tmp_path):
    def make(*names):
        for n in names:
            (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / n).write_text("x\n")

    found = lambda *a: sorted(r["file"].split(str(tmp_path) + "/")[1] for r in readers.discover(spark, str(tmp_path), *a).collect())
    make("deep/er/session_site_1.jsonl", "deep/x_site_2.txt", "deep/other.txt")
    assert found() == ["deep/er/session_site_1.jsonl", "deep/x_site_2.txt"] and found("1") == ["deep/er/session_site_1.jsonl"] and found("2", "deep") == ["deep/x_site_2.txt"]
    make("main/session_site_1.jsonl")
    assert found("", "main") == ["main/session_site_1.jsonl"] and len(found()) == 3
    make("session_site_3_part.jsonl")
    assert found("", "main") == ["session_site_3_part.jsonl"] and found("3", "main") == ["session_site_3_part.jsonl"] and found("4") == []
    names = spark.createDataFrame([("/x/site_a_b.txt",), ("/site_1/y.txt",), ("s_site_9.tar.gz",), ("z/site_q",)], "f string").select(readers.site_of(F.col("f")).alias("s")).collect()
    assert [r["s"] for r in names] == ["a", "unknown_site", "9.tar", "q"]


def test_bad_lines_are_kept(spark, tmp_path):
    (tmp_path / "l.txt").write_text('{"timestamp":"2026-01-01T00:00:00Z","a":1}\n\n{"timestamp":"soon"}\n{"a":2}\n[1]\n{"a":1} x\n{bad\n"text"\n')
    rows = readers.tagged_lines(spark, str(tmp_path), "timestamp string, a int", times.log_time).collect()
    assert sorted((r["reason"], r["line"]) for r in rows) == [("bad_json", x) for x in ('"text"', "[1]", '{"a":1} x', "{bad")] + [("bad_time", '{"a":2}'), ("bad_time", '{"timestamp":"soon"}'), ("ok", '{"timestamp":"2026-01-01T00:00:00Z","a":1}')]
    assert {r["record"]["a"] for r in rows if r["record"] is not None} == {1, 2, None}


def test_answers_clients_and_targets(spark):
    texts = ['x {"cluster_index": 3} y', 'a {"x":1} b {"cluster_index":2}', "none", '{"cluster_index": 4},{"a":1}', '{"a":1}],[{"b":2}', None]
    answers = spark.createDataFrame([(x,) for x in texts], "answer string")
    assert [r["cluster_index"] for r in reviews.parse_answers(answers).collect()] == [3]
    keys = spark.createDataFrame([(None, " ", "x"), (None, None, None), ("r", "s", "t")], "raw_client_ip string, source_ip string, src_ip string").select(sessions.client_key().alias("k")).collect()
    assert [r["k"] for r in keys] == ["x", "unknown_ip", "r"]
    paths = spark.createDataFrame([("//a/b?x=1",), ("http://h/p;q?x",), ("/a//b#f",), ("rel/x",)], "t string").select(u.target_path(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in paths] == ["//a/b", "/p", "/a//b", "rel/x"]
    line = spark.createDataFrame([('{"msg":"method:get;url://a/b?x=1;tag:waf_log_webaccess"}',)], "value string")
    assert events.parse_lines(line).first()["path"] == "//a/b"
    whole = spark.createDataFrame([("{}",), (' {"a": {"b": "}"}} ',), ("{} {}",), ("[{}]",), (None,), ("{",)], "x string").select(t.is_object(F.col("x")).alias("o")).collect()
    assert [r["o"] for r in whole] == [True, True, False, False, False, False]


METHODS = {"get", "post", "put", "patch", "delete", "head", "options"}


def naive_normal(api):
    parts = api.strip().split(maxsplit=1)
    return f"{parts[0].upper()} {parts[1]}" if len(parts) == 2 and parts[0].lower() in METHODS else api.strip()


def naive_match(call, doc):
    call, doc = naive_normal(call), naive_normal(doc)
    if not call or not doc:
        return False
    c, d = call.split(maxsplit=1), doc.split(maxsplit=1)
    if len(c) == len(d) == 2 and c[0] != d[0]:
        return False
    c, d = c[-1].rstrip("/"), d[-1].rstrip("/")
    return c == d or re.sub(r"/\d+|/[A-Fa-f0-9-]{8,}", "/{}", c) == re.sub(r"\{[^/]+\}", "{}", d) or c.endswith(d) or d.endswith(c)


def test_calls_meet_documents(spark):
    """Random paths of few segments, so that shapes, endings, roots and missing methods all meet; two sites."""
    rng = random.Random(11)
    part = lambda of: "/".join(rng.choice(of) for _ in range(rng.randint(0, 3)))
    docs = [(rng.choice("ab"), f"{rng.choice(['GET', 'POST'])} /{part(['rest', 'issue', '{id}', '{key}', 'x'])}{rng.choice(['', '/'])}") for _ in range(90)]
    docs = [(s, d, i) for i, (s, d) in enumerate(dict.fromkeys(docs))] + [("a", "", 900)]
    calls = [(rng.choice("ab"), f"{rng.choice(['GET ', 'get ', ' POST ', 'PUT ', '', 'odd '])}{rng.choice(['/', '/', ''])}{part(['rest', 'issue', '123', '0a1b2c3d', '{id}', 'x', '12ab'])}{rng.choice(['', '/'])}") for _ in range(300)] + [("a", None), ("a", " "), ("c", "GET /rest")]
    calls = [*dict.fromkeys(calls)]
    got = apidocs.documented(spark.createDataFrame(calls + calls[:5], "site string, api string"), spark.createDataFrame(docs + docs[:5], "site string, api string, n int"), ["site"], "n").collect()
    want = set()
    for site, call in calls:
        found = [d for s, d, _ in docs if s == site and naive_match(call or "", d)][:2]
        want |= {(site, call, d) for d in found or [None]}
    assert len(got) == len(want) and {(r["site"], r["api"], r["doc_api"]) for r in got} == want
    assert sum(d is not None for *_, d in want) > 100
    assert apidocs.documented(spark.createDataFrame([("GET /a",)], "api string"), spark.createDataFrame([], "api string")).collect() == [("GET /a", None, None)]


def scenario(**more):
    seq, par = more.pop("seq", None), more.pop("par", None)
    return {"scenario_title": 'a "t"', "overall_reason": "why", "risk_level": "high", "security_type": "BOLA", "sequence_order_risk": seq, "parameter_consistency_risk": par, **more}


def made(spark, *scenarios, index=None, **more):
    raw = json.dumps({"cluster_index": 1, "is_trustworthy": True, "possible_security_scenarios": scenarios})
    review = spark.createDataFrame([(raw,)], "answer string").select(F.from_json("answer", reviews.REVIEW_DDL).alias("r")).select("r.*")
    return [r.asDict(True) for r in rules.generate(review, index, **more).orderBy("fol_id").collect()]


def test_rules_fill_in_scopes(spark):
    """A scenario that names neither dependency nor source keeps its rule, with the defaults."""
    seq = {"normal_sequence_pattern": ["get /view", "", "POST /buy"], "possible_violation_sequence_pattern": ["POST /buy"], "missing_or_reordered_step": "GET /view is left out"}
    par = {"key_parameters_or_objects": ["orderId"], "target_apis": ["POST /buy"], "context_apis": ["get /view"]}
    first, second = made(spark, scenario(seq=seq, par=par, risk_type="both"), scenario(seq=seq, par=par, risk_type="parameter_consistency"))
    (e,) = first["logic_expressions"]
    assert e["dimension"] == "sequence_order_and_parameter_consistency" and first["status"] == "generated"
    assert [a["label"] for a in first["activity_abstraction"]["activities"]] == ["get /view", "normal_step_2", "POST /buy"]
    flow = '{C1},{T1},{P1}'
    assert second["logic_expressions"][0]["formula"] == (
        f'∀s (ParameterFlowContext(s,{flow},"stable_within_target_api") ∧ ParameterAppearsOrDerived(s,{{T1}},{{P1}}) ∧ ¬ParameterConsistentWithContext(s,{flow},"normal_sequence_context") → RatedParameterRisk(s,"BOLA","high","a \\"t\\""))'
    )
    assert e["formula"].startswith("∀s ((Occurs(s,A3) ∧ RequiredBefore(A1,A3) ∧ ¬Before(s,A1,A3) ∧ ParameterFlow") and e["scope"]["parameter"]["dependency_relation"] == "stable_within_target_api"
    assert first["related_apis"] == ["GET /view", "POST /buy"] and e["symbol_bindings"]["context_api_scope"] == [{"symbol": "C1", "value": "get /view"}]
    assert [o["role"] for o in e["scope"]["parameter"]["parameter_occurrences"]] == ["context_source", "target_parameter"] and first["formula_bindings"]["risk_type"] == "both"


def test_rules_from_documents(spark):
    """Calls with ids find their documents; targets fall back to the documents, and constants come from the riskiest one."""
    entry = "array<struct<name:string>>"
    index = spark.createDataFrame([("POST /order/{orderId}", "pay an order", [("orderId",), ("status",)], [("orderId",)], [("status",)], [("token",)], 1)], f"api string, summary string, parameters {entry}, object_parameters {entry}, sensitive_fields {entry}, auth_fields {entry}, n int")
    seq = {"normal_sequence_pattern": ["GET /x", "POST /order/12"], "possible_violation_sequence_pattern": ["POST /order/12", "POST /order/12"]}
    (r,) = made(spark, scenario(seq=seq, par={"key_parameters_or_objects": ["k"]}, risk_type="parameter_consistency"), index=index, place="n")
    p = r["logic_expressions"][0]["scope"]["parameter"]
    assert [x["api"] for x in r["openapi_summary"]] == ["GET /x", "POST /order/{orderId}"] and p["target_api_scope"] == ["GET /x"] and p["context_api_scope"] == ["POST /order/12"]
    assert {k: r["formula_bindings"][k] for k in ("api", "object_field", "sensitive_field", "auth_field")} == {"api": "POST /order/{orderId}", "object_field": "orderId", "sensitive_field": "status", "auth_field": "token"}


def test_rules_that_lack_something(spark):
    steps = {"normal_sequence_pattern": ["a", "b"]}
    got = made(spark, scenario(seq=steps, overall_reason="", scenario_title=" "), scenario(par={"target_apis": ["GET /a"]}), scenario(seq={"related_apis": ["GET /a"]}, risk_type="parameter_consistency"), scenario(seq={"normal_sequence_pattern": ["GET /a"]}, risk_type="sequence_order"), {})
    assert [(r["status"], r["missing_requirements"]) for r in got] == [("skipped", ["related_apis", "scenario_title", "overall_reason"]), ("skipped", ["activity_abstraction"]), ("generated", []), ("generated", []), ("skipped", ["related_apis", "scenario_title", "overall_reason"])]
    assert got[2]["logic_expressions"] == [] and got[3]["logic_expressions"][0]["formula"] == '∀s (Occurs(s,A1) ∧ RequiredBefore(A1,A1) ∧ ¬Before(s,A1,A1) → RatedSequenceOrderRisk(s,"BOLA","high","a \\"t\\""))'
    assert made(spark) == []
