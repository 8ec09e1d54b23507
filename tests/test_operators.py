"""Operators on small inputs against plain loops."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from weftlog.operators import boundary, detection, events, labeling, mining, profile, reviews, rules, sessions
from weftlog.operators.graph import components
from weftlog.sources import readers, writers


def loop_sessions(times, idle, seconds, most):
    out, now = [], []
    for t in sorted(times):
        if now and (t - now[-1] > idle or t - now[0] > seconds or len(now) >= most):
            out.append(now)
            now = []
        now.append(t)
    return out + [now] if now else out


@pytest.mark.parametrize("seed", range(3))
def test_capped_sessions_equal_loop(spark, seed):
    rng = random.Random(seed)
    rows, want = [], []
    for user in range(12):
        ts = sorted(rng.sample(range(5000), rng.randint(1, 60)))
        rows += [(user, float(t), i) for i, t in enumerate(ts)]
        want += [(user, s[0], s[-1], len(s)) for s in loop_sessions(ts, 100, 300, 6)]
    df = spark.createDataFrame(rows, "u int, t double, i int")
    got = sessions.capped(df, ["u"], "t", ["i"], 100, 300, 6).groupBy("u", "segment", "part").agg(F.min("t"), F.max("t"), F.count("*"))
    assert sorted((r.u, *r[3:]) for r in got.collect()) == sorted((u, float(a), float(b), n) for u, a, b, n in want)


def test_gap_bounds_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 600.0), (1, 1201.0), (1, None)], "u int, t double")
    assert [r.segment for r in sessions.by_gap(df, ["u"], "t", []).orderBy("t").collect()] == [0, 0, 1]
    assert sessions.by_gap(df.limit(0), ["u"], "t", []).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.range(60).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {i: find(i) for i in range(60)}
    assert components(spark.range(0).withColumnRenamed("id", "node"), spark.createDataFrame([], "a long, b long")).count() == 0


def gateway_line(**f):
    f = {"tag": "waf_log_webaccess", "site_id": "100", "raw_client_ip": "192.0.2.10", "request_id": "r1", "method": "GET", "ser_status_code": "200", "stat_time": "2026-06-16 08:00:00"} | f
    return json.dumps({"timestamp": "2026-06-16T08:00:00+08:00", "msg": ";".join(f"{k}:{v}" for k, v in f.items())})


def test_parse_lines(spark):
    http = base64.b64encode(b"POST /App/issue/12?id=7&id=8&q=a+b HTTP/1.1\r\nHost: x\r\n\r\n{\"k\": [1, 2]}").decode().rstrip("=")
    lines = [gateway_line(http=http, url="/ignored"), gateway_line(url="/a/b.css", tag="waf_log_websec", ser_status_code="x"), gateway_line(), "no json;url:/health;"]
    got = {r.value: r for r in events.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    a, b, c, d = (got[x] for x in lines)
    assert (a.reason, a.method, a.path, a.path_pattern, a.query, a.status_code, a.source_ip) == ("ok", "GET", "/App/issue/12", "/app/issue/{int}", "id=7&id=8&q=a+b", 200, "192.0.2.10")
    assert (a.param_name_set, a.param_type_pattern, a.repeated_params, a.body_param_name_set, a.body_param_count) == ("id,q", "id=<INT>&id=<INT>&q=<STR>", ["id"], "k[]", 2)
    assert (a.api_request_pattern, a.event_label) == ("GET /app/issue/{int}?id=<INT>&id=<INT>&q=<STR>", "normal")
    assert (b.url_type, b.event_label, b.status_code) == ("static_resource", "abnormal", None)
    assert c.reason == "missing_url" and d.url_type == "health_check"
    parsed = events.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.path for r in events.dynamic_events(parsed).collect()] == ["/App/issue/12"]
    assert events.sequence_tokens(events.dynamic_events(parsed)).first().token.endswith(" BODY k[]=<INT>&k[]=<INT>")
    assert events.run_counts(parsed).first().asDict() == {"ok": 3, "missing_url": 1, "static_resource": 1, "health_check": 1, "with_query": 1, "with_body_params": 1}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "t_site_9_1.txt").write_text("Step 1: GET /a\nStep 7: GET /b\n\n=== Session s1 Label:normal Length:3 ===\nStep 1: GET /c\n")
    got = readers.trace_steps(spark, str(tmp_path / "t_site_9_1.txt"), "9").orderBy("session_id", "step").collect()
    assert [(r.session_id, r.step, r.token) for r in got] == [("9_txt_0", 1, "GET /a"), ("9_txt_0", 2, "GET /b"), ("Session_s1_Label:normal_Length:3", 1, "GET /c")]
    one = json.dumps({"session_id": "x", "site_id": "a_b", "api_sequence": ["GET /a", "GET /b"]}, indent=2)
    (tmp_path / "one.jsonl").write_text(one)
    (tmp_path / "two.jsonl").write_text(one + "\n\n" + one.replace('"x"', '"y"') + "\n\n")
    (tmp_path / "lines.jsonl").write_text('{"session_id": "p", "api_sequence": ["z"]}\nbad\n{"session_id": "q", "api_sequence": []}\n')
    count = lambda f: sorted(r.session_id for r in readers.json_blocks(spark, str(tmp_path / f)).collect())
    assert (count("one.jsonl"), count("two.jsonl"), count("lines.jsonl")) == (["x"], ["x", "y"], ["p", "q"])
    steps = readers.session_steps(readers.json_blocks(spark, str(tmp_path / "two.jsonl")))
    assert steps.count() == 4
    block = writers.trace_text(steps.withColumn("session_label", F.lit("normal"))).filter(F.col("value").contains("x Label")).first().value
    assert block == "=== Session x Label:normal Length:2 ===\nStep 1: GET /a\nStep 2: GET /b\n"
    line = lambda s: spark.createDataFrame([(s,)], "v string").select(writers.append_fields(F.col("v"), label=F.lit(1)).alias("o")).first().o
    assert (line('{"a":1}\n'), line("{}"), json.loads(line("raw")), json.loads(line('{"a":1} '))) == ('{"a":1,"label":1}', '{"label":1}', {"raw_line": "raw", "label": 1}, {"raw_line": '{"a":1} ', "label": 1})


def test_labels(spark):
    access = spark.createDataFrame([("r1", 1), ("r2", 2), (None, 3)], "id string, n int")
    security = spark.createDataFrame([("r1", "sqli", 2), ("r1", "xss", 1), ("r9", "", 3), (None, "x", 4)], "id string, kind string, at int")
    got = {r.n: (r.label, r.security_event_type) for r in labeling.label(access, security, "id", "kind", ["at"]).collect()}
    assert got == {1: (1, "xss"), 2: (0, "none"), 3: (0, "none")}
    assert sorted(r.kind for r in labeling.matched(security, access, "id").collect()) == ["sqli", "xss"]
    assert labeling.unmatched(security, access, "id").count() == 2


def brute_vectors(seqs, w=mining.Weights()):
    import math
    longest, out = max(map(len, seqs)), []
    for s in seqs:
        v = {}
        add = lambda k, x: v.__setitem__(k, v.get(k, 0) + x)  # noqa: E731, B023
        for a in set(s):
            add(("seen", a), w.presence)
            add(("freq", a), w.frequency * math.log(min(s.count(a), w.cap) + 1))
        for i in range(len(s)):
            for d in range(1, w.max_skip + 1):
                if i + d < len(s):
                    add(("direct" if d == 1 else "skip", s[i], s[i + d]), w.direct if d == 1 else w.skip / d)
        add(("start", s[0]), w.endpoint)
        add(("end", s[-1]), w.endpoint)
        add("len", w.length * math.log(len(s) + 1) / math.log(longest + 1))
        out.append(v)
    return out


def brute_dbscan(dist, n, eps, least):
    near = [[j for j in range(n) if dist(i, j) <= eps] for i in range(n)]
    label, c = [None] * n, -1
    for i in range(n):
        if label[i] is not None:
            continue
        if len(near[i]) < least:
            label[i] = -1
            continue
        c += 1
        label[i], todo = c, list(near[i])
        while todo:
            j = todo.pop(0)
            if label[j] == -1:
                label[j] = c
            if label[j] is None:
                label[j] = c
                if len(near[j]) >= least:
                    todo += near[j]
    return label


@pytest.mark.parametrize("seed", range(2))
def test_clusters_equal_brute_force(spark, seed):
    import math
    rng = random.Random(seed)
    seqs = [[rng.choice("abcdef") for _ in range(rng.randint(1, 6))] for _ in range(40)]
    vs = brute_vectors(seqs)
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vs]
    dist = lambda i, j: 0.0 if i == j else 1 - min(1, sum(x * vs[j].get(k, 0) for k, x in vs[i].items()) / norm[i] / norm[j])
    steps = spark.createDataFrame([(f"s{i:03}", k + 1, a) for i, s in enumerate(seqs) for k, a in enumerate(s)], "session_id string, step int, api string")
    got = mining.cluster_sessions(steps, eps=0.3)
    labels = {r.session_id: r.cluster for r in got["sessions"].collect()}
    assert [labels[f"s{i:03}"] for i in range(40)] == brute_dbscan(dist, 40, 0.3 + 1e-12, 3)
    auto = mining.cluster_sessions(steps)["eps"]
    kth = sorted((sorted(dist(i, j) for j in range(40) if j != i)[1] for i in range(40)), reverse=True)
    dx, dy = 39.0, kth[-1] - kth[0]
    away = [round(abs(dy * i - dx * y + dx * kth[0]) / math.hypot(dx, dy), 12) for i, y in enumerate(kth)]
    assert abs(auto - min(0.6, max(0.15, kth[away.index(max(away))]))) < 1e-6


def test_far_distances_count(spark):
    """Medoids of loose clusters and k-th neighbours beyond eps_max, also without any shared feature."""
    import math
    rng = random.Random(7)
    seqs = [[rng.choice("abcdef") for _ in range(rng.randint(1, 9))] for _ in range(60)] + [["x"], ["y", "y"], ["z"] * 9] + [["a", f"p{i}", f"q{i}", "b", f"p{i}"] for i in range(4)]
    n, vs = len(seqs), brute_vectors(seqs)
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vs]
    dist = lambda i, j: 0.0 if i == j else 1 - min(1, sum(x * vs[j].get(k, 0) for k, x in vs[i].items()) / norm[i] / norm[j])
    kth = [sorted(dist(i, j) for j in range(n) if j != i)[1] for i in range(n)]
    assert sum(0.6 < d < 0.95 for d in kth) > 1 and max(kth) > 0.95
    steps = spark.createDataFrame([(f"s{i:03}", k + 1, a) for i, s in enumerate(seqs) for k, a in enumerate(s)], "session_id string, step int, api string")
    distinct, of = mining.sequences(steps)
    vector = mining.vectors(distinct)
    norms = mining.norms(distinct, vector)
    got = mining.kth_distances(distinct, mining.close_pairs(vector, norms, 0.6), vector, norms, 3, n).join(of, "seq").collect()
    assert len(got) == n and all(abs(r.k_dist - kth[int(r.session_id[1:])]) < 1e-9 for r in got)
    labels = distinct.select("seq", F.when(F.col("first") < "s040", 0).when(F.col("first") < "s060", 1).otherwise(-1).alias("cluster"))
    cluster = {r.session_id: r.cluster for r in of.join(labels, "seq").collect()}
    found = {r.cluster: r for r in mining.medoids(distinct, labels, vector, norms).join(distinct.select("seq", "first"), "seq").collect()}
    for c in (0, 1):
        members = [i for i in range(n) if cluster[f"s{i:03}"] == c]
        totals = {i: round(sum(dist(i, j) for j in members), 9) for i in members}
        best = min(members, key=lambda i: (totals[i], i))
        assert found[c].first == f"s{best:03}" and abs(found[c].total - totals[best]) < 1e-6
    assert set(found) == {0, 1}


def test_detection_quirks(spark):
    from weftlog.plans.queries import demo_rules
    steps = spark.createDataFrame([("s", i + 1, a, v) for i, (a, v) in enumerate([("purchase", "1"), ("view", "2"), ("purchase", "3"), ("error", "4"), ("error", "null")])] + [("t", 1, "view", "5"), ("t", 2, "purchase", "5")], "session_id string, step int, api string, v string")
    values = steps.select("session_id", "step", "api", F.lit("a.K").alias("name"), F.col("v").alias("value"))
    exprs = detection.expressions(detection.active(demo_rules(spark)))
    hits = {(r.session_id, r.fol_id, r.reason, r.step, r.detail) for r in detection.detect(steps, values, exprs).collect()}
    assert hits == {
        ("s", "R1", "repeated_call", 4, "2"), ("s", "R2", "required_before_missing", 1, ""), ("s", "R4", "parameter_value_switch", 1, "1,3"), ("s", "R5", "parameter_value_switch", 1, "1,3"),
        ("s", "R5", "parameter_not_from_context", 1, "1,3"), ("s", "R6", "combined_sequence_parameter_risk", 1, "1+2"),
    }
    noisy = spark.createDataFrame([("s", 1, "GET /a.js"), ("s", 2, "GET /b")], "session_id string, step int, api string")
    assert [(r.step, r.api, r.dropped) for r in detection.business_steps(noisy).collect()] == [(1, "GET /b", 1)]


def test_unknown_required_step_hits_every_target(spark):
    exprs = spark.createDataFrame([("R", 1, "sequence_order", "missing_or_reordered_step", None, 2, None, "b")], "fol_id string, expr int, dimension string, mode string, activity_api string, threshold int, required_api string, target_api string")
    steps = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "b")], "session_id string, step int, api string")
    assert sorted(r.step for r in detection.missing_before(steps, exprs).collect()) == [2, 3]


def test_boundary_objects(spark):
    t = spark.createDataFrame([("s", 1, "GET /rest/project/ABC/issue/ABC-12?userId=u7&limit=5"), ("s", 2, 'POST /rest/x BODY {"issueKey": "QQ-1"}')], "session_id string, step int, token string")
    got = boundary.refs(boundary.event_objects(t)).orderBy("step").collect()
    assert got[0].projects == ["projectKey:ABC"] and got[0].issues == ["issueKey:ABC-12"] and got[0].hints == ["u7"]
    assert got[1].issues == ["issueKey:QQ-1"]
    rel = {(r.project, r.issue): r.n for r in boundary.project_issues(boundary.with_upstream(boundary.refs(boundary.event_objects(t)))).collect()}
    assert rel == {("projectKey:ABC", "issueKey:ABC-12"): 2, ("projectKey:ABC", "issueKey:QQ-1"): 1, ("projectKey:QQ", "issueKey:QQ-1"): 1}


def test_profile_last_pair_type(spark):
    r = spark.createDataFrame([(1, "s", "/a", "GET", [("x", "1"), ("x", "y")]), (2, "s", "/a", "GET", [])], "id int, site_id string, path string, method string, p array<struct<name:string,value:string>>")
    row = profile.parameters(r, "id", "query", "p").first()
    assert (row["count"], row.present_count, row.types, row.examples, row.required_ratio) == (2, 1, "STR", "1 | y", 0.5)


def test_streaming_sessions(spark, tmp_path):
    from weftlog.streaming.sessions import gap_sessions
    df = spark.createDataFrame([(1, 0), (1, 300), (1, 2000), (2, 100), (3, 90000)], "u int, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = gap_sessions(stream, ["u"], "ts").writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.u, r.session_length) for r in spark.sql("select u, session_length from sess").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_headers_of_each_kind(spark):
    rows = [(1, {"A": "x"}, [["C", "y"], ["D"]], '{"B": 2}', "[1]"), (2, None, None, "{bad", None), (3, None, [["C", "y", "z"]], "text", "{}")]
    df = spark.createDataFrame(rows, "id int, headers map<string,string>, request_headers array<array<string>>, header_params string, requestHeaders string")
    got = {r["id"]: [tuple(p) for p in r["header_pairs"]] for r in profile.headers(df).collect()}
    assert got == {1: [("A", "x")], 2: [], 3: [("C", "y")]}
    alone = {r["id"]: [tuple(p) for p in r["header_pairs"]] for r in profile.headers(df.select("id", "header_params")).collect()}
    assert alone == {1: [("B", "2")], 2: [], 3: []}
    assert [r["header_pairs"] for r in profile.headers(df.select("id")).collect()] == [[], [], []]


def test_contents_is_no_object_type(spark):
    df = spark.createDataFrame([("contents",), ("content",), ("issues",), ("x",)], "s string")
    assert [r[0] for r in df.select(boundary.segment_type(F.col("s"))).collect()] == ["", "content", "issue", ""]


def test_evidence_and_summary(spark):
    hits = spark.createDataFrame([("s2", "R1", 1, "a", 3, "", ""), ("s1", "R1", 1, "a", 1, "", ""), ("s1", "R1", 1, "a", 2, "", ""), ("s3", "R2", 1, "b", 1, "", "")], "session_id string, fol_id string, expr int, reason string, step int, parameter string, detail string")
    steps = spark.createDataFrame([("s1", 1, "x", 4), ("s1", 2, "y", 4), ("s2", 1, "x", 0), ("s3", 1, "z", 1), ("s4", 1, "z", 0)], "session_id string, step int, api string, dropped int")
    rules = spark.createDataFrame([("R1", "q"), ("R2", "q"), ("R3", "q")], "fol_id string, source string")
    assert sorted((r["session_id"], r["fol_id"], r["step"]) for r in detection.capped_evidence(hits, 1).collect()) == [("s1", "R1", 1), ("s1", "R1", 2), ("s3", "R2", 1)]
    got = {r["fol_id"]: r.asDict() for r in detection.run_summary(hits, steps, rules, 1).collect()}
    assert [(got[k]["rule_hit_count"], got[k]["emitted_count"]) for k in ("R1", "R2", "R3")] == [(2, 1), (1, 1), (0, 0)]
    assert {(r["session_count"], r["filtered_noise_count"], r["hit_session_count"], r["rule_count"], r["finding_count"]) for r in got.values()} == {(4, 5, 2, 3, 2)}
    found = {(r["fol_id"], r["session_id"]): r for r in detection.session_findings(hits, steps, rules).collect()}
    assert found["R1", "s1"]["api_sequence"] == ["x", "y"] and found["R1", "s1"]["filtered_noise_count"] == 4 and len(found["R1", "s1"]["expression_hits"]) == 2


def test_request_values_of_shapes(spark):
    rows = [("a", 1, "POST /x?p=1&q BODY {\"k\": [1, {\"n\": null}]}"), ("a", 2, "GET /y BODY u=%41&u=b"), ("a", 3, "not a request"), ("a", 4, None)]
    got = {(r["step"], r["name"], r["value"], r["api"]) for r in detection.request_values(spark.createDataFrame(rows, "session_id string, step int, token string")).collect()}
    assert got == {(1, "p", "1", "POST /x"), (1, "q", "", "POST /x"), (1, "k[0]", "1", "POST /x"), (1, "k[1].n", "None", "POST /x"), (2, "u", "A", "GET /y"), (2, "u", "b", "GET /y")}


CONTEXT = "array<struct<api:string,summary:string,operation_id:string,parameters:array<string>,object_parameters:array<string>,sensitive_fields:array<string>>>"


def test_risk_api_equals_loop(spark):
    import re

    rng = random.Random(4)
    words = ["issue", "user/role", "delete", "search", "login", "page_tree", "export-all", "枚举对象", "GET", "rest", "x1y2", "config"]
    scenes = []
    for i in range(60):
        text = " ".join(rng.choices(words + ["/rest/user/role", "attack"], k=6))
        some = [(f"GET /{rng.choice(words)}/{rng.choice(words)}", rng.choice([None, "export"]), rng.choice(words), rng.choices(words, k=rng.randrange(4)), rng.choice([None, [], ["id"]]), rng.choice([None, ["role"]])) for _ in range(rng.randrange(5))]
        scenes.append((i, text, rng.choice(["BOLA", "BFLA", "BOPLA", "AUTH_BYPASS", "RESOURCE_CONSUMPTION", "OTHER"]), some))
    scenes.append((60, None, "BOLA", None))

    def best(text, kind, context):
        tokens = set()
        for t in re.findall("[A-Za-z][A-Za-z0-9_/-]{2,}", text or ""):
            t = t.strip("/").lower()
            if t and t not in rules.PLAIN_TOKENS:
                tokens |= {t} | {x for x in re.split("[/_-]+", t) if len(x) > 2}
        tokens |= set(re.findall("[\u4e00-\u9fff]{2,}", text or ""))
        found = []
        for at, (api, summary, op, params, objects, sensitive) in enumerate(context or []):
            t = " ".join([api, summary or "", op, " ".join(params)])
            bonus = {"BOLA": 4 * bool(objects), "BFLA": 5 * bool(re.search(rules.ADMIN, t)), "BOPLA": 5 * bool(sensitive), "AUTH_BYPASS": 5 * bool(re.search(rules.AUTH, t)), "RESOURCE_CONSUMPTION": 4 * bool(re.search(rules.FREQUENT, t))}.get(kind, 0)
            risky = 2 if re.search(rules.ATTACK, text) and re.search(rules.RISKY_PARTS, t.lower()) else 0
            found.append((sum(3 if "/" in x else 1 for x in tokens if x in t.lower()) + bonus + risky, len(params), -at, api))
        return (max(found)[3], max(found)[0]) if found else (None, None)

    got = {r["i"]: (r["api"], r["score"]) for r in rules.risk_api(spark.createDataFrame(scenes, f"i int, text string, security_type string, context {CONTEXT}")).collect()}
    assert got == {i: best(t, k, c) for i, t, k, c in scenes}


def test_parameter_blocks_titles_and_bindings(spark):
    seq = (["GET /a", "view", "POST /b"], ["POST /b"], "", "", "skip", ["GET /c", "GET /a"])
    rows = [(1, True, 0.9, "p", [], [
        ("", "重复调用", "", "", "", None, (["orderId", " "], [], [], "unknown", "", "reuse of issueKey"), "/trigger/7 and orderId", ""),
        ("", "something", "", "", "", seq, None, "", ""),
        ("", "", "", "", "", seq, (["k"], ["PUT /t"], ["GET /u"], "own", "here", "x"), "both", ""),
        ("", "bare", "", "", "", None, None, "", ""),
    ])]
    whole = lambda s: (*s[:6], s[6] and (*s[6], None, None, None), *s[7:], *[None] * (2 + len(reviews.DETAILS)))
    rows = [(*r[:5], [whole(s) for s in r[5]]) for r in rows]
    raw = spark.createDataFrame(rows, reviews.REVIEW_DDL)
    blocks = reviews.parameter_blocks(raw)
    got = {r["pos"]: r for r in blocks.collect()}
    assert got[0]["parameters"] == ["orderId", "issueKey", "triggerId"] and got[0]["target_apis"] == [] and got[0]["dependency"] == "stable_within_target_api"
    assert got[1]["target_apis"] == ["GET /c"] and got[1]["context_apis"] == ["GET /a", "POST /b"] and got[1]["expected_source"] == "upstream_context_api"
    assert (got[2]["target_apis"], got[2]["context_apis"], got[2]["dependency"], got[2]["expected_source"]) == (["PUT /t"], ["GET /u"], "own", "here")
    assert got[3]["parameters"] == [] and got[3]["context_apis"] == []
    assert sorted((r["pos"], r["parameter"], r["api"], r["role"]) for r in reviews.parameter_occurrences(blocks).collect()) == [(2, "k", "GET /u", "context_source"), (2, "k", "PUT /t", "target_parameter")]
    assert [(r["pos"], r["source_api"], r["target_api"], r["relation"]) for r in reviews.context_bindings(blocks).collect()] == [(2, "GET /u", "PUT /t", "own")]
    titles = [s["scenario_title"] for s in reviews.normalise(raw).first()["possible_security_scenarios"]]
    assert titles == ["orderId 上下文不一致导致的对象级访问风险", "b 业务顺序约束绕过风险", "k 上下文参数与业务顺序共同绕过风险"]
