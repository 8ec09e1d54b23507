"""The operators applied to the driver's tables: events as a request log, pages as requested URLs, orders as records to label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.functions import text as t
from weftlog.functions import url as u
from weftlog.operators import boundary, detection, labeling, mining, openapi, profile, reviews, rules, sessions
from weftlog.operators import events as log
from weftlog.operators.graph import written
from weftlog.streaming import sessions as streamed

IDLE = 21_600
CAP_SECONDS, CAP_EVENTS = 7_200, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to two tasks a core: a file of few bytes is read by few tasks, however much is made of its rows."""
    spark = df.sparkSession
    return df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(24, 2 * spark.sparkContext.defaultParallelism)), *by)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``sec`` (seconds) and ``k`` (the one property)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.get_json_object("props", "$.k").cast("int").alias("k")).withColumn("sec", F.col("us") / 1e6)


def event_sessions(spark: SparkSession, sf_dir: str, idle: int = IDLE) -> DataFrame:
    found = sessions.by_gap(events(spark, sf_dir), ["user_id"], "sec", ["event_id"], idle)
    return found.withColumn("session_id", F.concat_ws("_", "user_id", "segment"))


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the sessions; the user's segment is the session, so its window partitioning is kept."""
    return sessions.steps(event_sessions(spark, sf_dir), ["user_id", "segment"], "sec", ["event_id"]).withColumn("api", F.col("event_type"))


def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    return sessions.summaries(s, ["user_id"], ["segment"], "us", ["event_id"], F.col("event_type") == "error")


def session_gap_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir, sessions.IDLE)
    return sessions.summaries(s, ["user_id"], ["segment"], "us", ["event_id"], F.col("event_type") == "error")


def session_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.capped(events(spark, sf_dir), ["user_id"], "sec", ["event_id"], IDLE, CAP_SECONDS, CAP_EVENTS)
    return sessions.summaries(s, ["user_id"], ["segment", "part"], "us", ["event_id"], F.col("event_type") == "error")


def session_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_gap(spark, sf_dir)
    return s.groupBy("session_length", sessions.length_bucket(F.col("session_length")).alias("bucket")).agg(F.count("*").alias("n_sessions"), F.count_if(F.col("session_label") == "abnormal").alias("n_abnormal"))


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator on the static table."""
    e = events(spark, sf_dir).withColumn("at", F.timestamp_micros("us"))
    out = streamed.gap_sessions(e, ["user_id"], "at", f"{IDLE} seconds", abnormal=F.col("event_type") == "error")
    return out.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "session_length", "session_label")


def dfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.directly_follows(event_steps(spark, sf_dir), ["user_id", "segment"])


def skip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = mining.skip_pairs(event_steps(spark, sf_dir), ["user_id", "segment"])
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


def role_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("step"), F.col("role").alias("api"))
    return mining.directly_follows(turns, ["conv_id"])


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.trace_summary(event_steps(spark, sf_dir), ["user_id", "segment"])


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = u.clean_target(F.col("url"))
    p = table(spark, sf_dir, "pages").select("page_id", url.alias("raw_url"))
    p = p.withColumns({"site_id": F.regexp_extract("raw_url", r"^[a-z]+://([^/?#]*)", 1), "full_path": u.percent_decode(u.raw_path(F.col("raw_url"))), "query": u.raw_query(F.col("raw_url")), "method": F.lit("GET")})
    return p.withColumns({"path": u.path_template(F.col("full_path")), "url_type": u.path_class(F.col("full_path")), "param_pairs": u.query_pairs(F.col("query"))})


def url_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_requests(spark, sf_dir)
    return p.select("page_id", "site_id", F.col("full_path").alias("path"), F.col("path").alias("path_pattern"), "query", "url_type", t.name_set(F.col("param_pairs")).alias("param_name_set"), t.type_pattern(F.col("param_pairs")).alias("param_type_pattern"), u.path_fingerprint(F.col("path")).alias("fingerprint"))


def method_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.methods(page_requests(spark, sf_dir), ["path", "method"], {"query": "param_pairs"})


def parameter_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.parameters(page_requests(spark, sf_dir), "page_id", "query", "param_pairs", ["path", "method"])
    return p.select("path", "method", "location", "param", "request_count", "count", "present_count", "empty_count", "required_ratio", "empty_ratio", "types", "examples")


def parameter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.parameter_sets(page_requests(spark, sf_dir), "page_id", "param_pairs", ["path", "method"])


def request_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.samples(page_requests(spark, sf_dir), "page_id").select("site_id", "path", "method", "page_id", F.col("at").alias("sample_no"))


def top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_paths(profile.methods(page_requests(spark, sf_dir), columns={"query": "param_pairs"}), 3)


def site_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.site_totals(profile.methods(page_requests(spark, sf_dir), columns={"query": "param_pairs"}))


def header_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the pages' requests: a JSON object, or no object for every seventh."""
    object_ = F.to_json(F.create_map(F.lit("Host"), "site_id", F.lit("X-Page"), F.col("page_id").cast("string")))
    p = page_requests(spark, sf_dir).withColumn("request_headers", F.when(F.col("page_id") % 7 == 0, "[1]").otherwise(object_))
    found = profile.parameters(profile.headers(p), "page_id", "header", "header_pairs", ["site_id"])
    return found.select("site_id", "location", "param", "request_count", "count", "present_count", "types", "examples")


def path_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_requests(spark, sf_dir)
    return p.select("page_id", F.explode(u.path_bindings(F.col("path"), F.col("full_path"))).alias("p")).select("page_id", "p.name", "p.value")


def gateway_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as gateway lines: odd pages with an encoded request and its body, even ones with a URL; every fifth a security record."""
    page = F.col("page_id")
    target = F.regexp_replace("raw_url", r"^[a-z]+://[^/?#]*", "")
    sent = F.base64(F.concat(F.lit("POST "), target, F.lit(" HTTP/1.1\r\nHost: x\r\n\r\npage="), page.cast("string"), F.lit("&kind=odd")).cast("binary"))
    how = F.when(page % 2 == 1, F.concat(F.lit("http:"), F.regexp_replace(sent, r"[\r\n]", ""))).otherwise(F.concat(F.lit("method:get;url:"), target))
    fields = F.concat(
        F.lit("tag:"), F.when(page % 5 == 0, "waf_log_websec").otherwise("waf_log_webaccess"), F.lit(";site_id:"), "site_id", F.lit(";raw_client_ip:192.0.2."), (page % 250).cast("string"), F.lit(";request_id:r"), page.cast("string"),
        F.lit(";"), how, F.lit(";ser_status_code:"), (200 + page % 3).cast("string"), F.lit(";event_type:none;stat_time:2026-06-16 08:00:00"),
    )
    return page_requests(spark, sf_dir).select(F.to_json(F.struct(F.lit("2026-06-16T08:00:00+08:00").alias("timestamp"), fields.alias("msg"))).alias("value"))


def gateway_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = log.sequence_tokens(log.parse_lines(gateway_lines(spark, sf_dir)))
    return parsed.select(
        "request_id", "site_id", "tag", "timestamp", "source_ip", "method", "status_code", "path", "path_pattern", "query", "url_type", "event_label", "event_type", "reason", "param_name_set", "param_type_pattern", "param_count",
        "body_param_name_set", "body_param_type_pattern", "body_param_count", "api_request", "api_request_pattern", "api_request_param_names", "token", "full_request",
    )


def gateway_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.run_counts(log.parse_lines(gateway_lines(spark, sf_dir)))


def openapi_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.parameters(page_requests(spark, sf_dir), "page_id", "query", "param_pairs", ["site_id", "path", "method"])
    return profile.openapi_paths(p)


def part_documents(spark: SparkSession, sf_dir: str, last: str) -> DataFrame:
    """A document for each part: a path of its brand and column ``last``, a method by its size, parameters, and a nested body named from its name."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey")
    word = lambda i: F.split("p_name", " ")[i]
    body = F.format_string('{"type":"object","required":["%1$s"],"properties":{"%1$s":{"type":"object","properties":{"role":{"type":"string"}}},"%2$s":{}}}', word(0), word(1))
    op = F.format_string('{"summary":"%s","parameters":[{"name":"partId","in":"path","required":true,"schema":{"type":"integer"}},{"name":"token","in":"body","schema":{"type":"string","format":null}}],"requestBody":{"content":{"application/json":{"schema":%s}}}}', F.col("p_name"), body)
    method = F.element_at(F.array(*[F.lit(m) for m in ("get", "put", "post")]), F.col("p_size") % 3 + 1)
    path = F.concat(F.lit("/parts/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), F.col(last).cast("string"), F.lit("/{partId}"))
    return p.select(F.col("p_type").alias("site_id"), "p_partkey", F.concat(F.lit('{"openapi":"3.2.0","paths":{"'), path, F.lit('":{"'), method, F.lit('":'), op, F.lit('}}}')).alias("doc"))


def openapi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda c: F.array_join(F.transform(c, lambda p: p["name"]), ",").alias(c)
    found = openapi.index(openapi.entries(part_documents(spark, sf_dir, "p_partkey")))
    needed = F.array_join(F.transform(F.filter("parameters", lambda p: p["required"]), lambda p: F.concat_ws(":", p["name"], p["in"], p["type"])), ",")
    return found.select("site_id", "api", "summary", names("parameters"), needed.alias("required"), names("object_parameters"), names("sensitive_fields"), names("auth_fields"))


def openapi_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of odd parts as they are; into them are merged every fourth part's, and of the others those with a path that is new."""
    docs = part_documents(spark, sf_dir, "p_size")
    old, always, other = [openapi.entries(docs.filter(w)) for w in ("p_partkey % 2 = 1", "p_partkey % 4 = 0", "p_partkey % 4 = 2")]
    new = always.union(openapi.unseen(other, old)).withColumn("ordinal", F.lit(1))
    merged = openapi.merge(old, new)
    listed = F.size(F.from_json(F.get_json_object("value", "$.parameters"), "array<string>"))
    token = F.get_json_object("value", "$.requestBody.content['application/json'].schema.properties.token.type")
    return merged.select("site_id", "path", "key", listed.alias("n_parameters"), F.coalesce(token, F.lit("")).alias("body_token"))


def value_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(t.value_type(F.col("w")).alias("kind")).agg(F.count("*").alias("n"))


def orders_and_returns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("id"))
    r = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws("-", "l_linestatus", "l_linenumber").alias("kind"), "l_extendedprice")
    return o, r


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "kind"]


def label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, r = orders_and_returns(spark, sf_dir)
    return labeling.label(o, r, "id", "kind", ORDER).select("o_orderkey", "o_orderstatus", "label", "security_event_type", F.coalesce(F.col("matched_id").cast("string"), F.lit("")).alias("matched_id"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.label_counts(label_left_join(spark, sf_dir))


def label_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, r = orders_and_returns(spark, sf_dir)
    return labeling.matched(r, o.filter("o_orderstatus = 'F'"), "id").select("id", "l_linenumber", "l_partkey", "l_suppkey", "kind")


def label_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, r = orders_and_returns(spark, sf_dir)
    return labeling.unmatched(r, o.filter("o_orderstatus = 'F'"), "id").select("id", "l_linenumber", "l_partkey", "l_suppkey", "kind")


def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = labeling.in_window(table(spark, sf_dir, "events"), "ts", F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-06 00:00:00")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


RULES_DDL = "fol_id string, status string, source struct<scenario_id:string>, refinement struct<disabled:boolean>, activity_abstraction struct<activities:array<struct<symbol:string,label:string>>>, logic_expressions array<struct<dimension:string,formula:string,scope:struct<sequence:struct<mode:string,activity:string,threshold:string,required_activity:string,target_activity:string>,parameter:struct<parameters:array<string>,target_api_scope:array<string>,context_api_scope:array<string>,dependency_relation:string,expected_source:string>>>>"
ACTIVITIES = [("A1", "view"), ("A2", "purchase"), ("A3", "error"), ("A4", "click")]
REPEATED, MISSING, RISKY = ("repeated_call", "A3", "2", None, None), ("missing_or_reordered_step", None, None, "A1", "A2"), ("risky_order", None, None, None, "A4")
SWITCH, BOUND = (["k"], ["purchase"], [], "", ""), (["k"], ["purchase"], ["view", "click"], "derived_from_context_api", "")


def demo_rules(spark: SparkSession) -> DataFrame:
    """Rules over event types, one of each kind."""
    def rule(name: str, dimension: str, seq, par):
        return (name, "generated", (name,), (False,), (ACTIVITIES,), [(dimension, "", (seq, par))])

    rows = [
        rule("R1", "sequence_order", REPEATED, None), rule("R2", "sequence_order", MISSING, None), rule("R3", "sequence_order", RISKY, None),
        rule("R4", "parameter_consistency", None, SWITCH), rule("R5", "parameter_consistency", None, BOUND), rule("R6", "sequence_order_and_parameter_consistency", MISSING, BOUND),
        ("R7", "skipped", ("R7",), (False,), (ACTIVITIES,), [("sequence_order", "", (REPEATED, None))]),
    ]
    return spark.createDataFrame(rows, RULES_DDL)


def event_values(steps: DataFrame) -> DataFrame:
    return steps.select("session_id", "step", "api", F.lit("props.k").alias("name"), F.col("k").cast("string").alias("value"))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = written(event_steps(spark, sf_dir).select("session_id", "step", "api", "k"))  # read once for each kind of rule
    return detection.detect(steps, event_values(steps), detection.expressions(detection.active(demo_rules(spark))))


def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.findings_by_rule(rule_hits(spark, sf_dir))


EVIDENCE = 50


def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their hits and the session's sequence, up to ``EVIDENCE`` sessions of each rule."""
    steps = written(event_steps(spark, sf_dir).select("session_id", "step", "api", "k"))
    used = detection.active(demo_rules(spark))
    hits = written(detection.detect(steps, event_values(steps), detection.expressions(used)))
    found = detection.session_findings(detection.capped_evidence(hits, EVIDENCE), steps, used)
    shown = F.array_join(F.transform("expression_hits", lambda h: F.concat_ws("@", h["reason"], h["step"].cast("string"))), ",")
    return found.select("fol_id", "session_id", F.col("source.scenario_id").alias("scenario_id"), shown.alias("hits"), F.array_join("api_sequence", ">").alias("trace"), F.col("filtered_noise_count").cast("bigint").alias("filtered_noise_count"))


def rule_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = written(event_steps(spark, sf_dir).select("session_id", "step", "api", "k"))
    used = detection.active(demo_rules(spark))
    hits = written(detection.detect(steps, event_values(steps), detection.expressions(used)))
    return detection.run_summary(hits, steps, used, EVIDENCE)


def request_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query and body parameters of the pages' requests, a site's pages being a session."""
    p = page_requests(spark, sf_dir).withColumn("step", F.row_number().over(Window.partitionBy("site_id").orderBy("page_id")))
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" BODY page="), F.col("page_id").cast("string"), F.lit("&kind=even+page"))).otherwise("")
    return detection.request_values(p.select(F.col("site_id").alias("session_id"), "step", F.concat(F.lit("GET "), "raw_url", body).alias("token")))


def business_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps left of the pages' requests without front-end files, and how many a site lost."""
    p = page_requests(spark, sf_dir).withColumn("step", F.row_number().over(Window.partitionBy("site_id").orderBy("page_id")))
    asset = F.when(F.col("page_id") % 3 == 0, "/static/app.js").when(F.col("page_id") % 5 == 0, "/logo.PNG?v=2").otherwise(F.col("path"))
    return detection.business_steps(p.select(F.col("site_id").alias("session_id"), "step", F.concat_ws(" ", F.lit("GET"), asset).alias("api")))


def noise_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions hit by the missing-step rule against the noise of density clustering."""
    return detection.noise_overlap(rule_hits(spark, sf_dir).filter("fol_id = 'R2'"), mining.noise_sessions(clusters(spark, sf_dir)))


def object_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as requests: purchases name projects, other events issues, by their property."""
    s = event_steps(spark, sf_dir)
    project = F.concat(F.lit("GET /rest/project/P"), (F.col("k") % 10).cast("string"))
    issue = F.concat(F.lit("GET /rest/issue/PRJ"), (F.col("k") % 7).cast("string"), F.lit("-"), F.col("k").cast("string"))
    s = s.withColumn("token", F.when(F.col("event_type") == "purchase", project).otherwise(issue))
    s = s.select("session_id", "step", "token", F.lit(None).cast("string").alias("user_hint"), F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("source_ip"))
    return boundary.with_upstream(boundary.refs(boundary.event_objects(s)))


def boundary_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.project_issues(object_events(spark, sf_dir))


def project_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.supported(boundary_relations(spark, sf_dir), "project", "issue")


def actor_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = written(object_events(spark, sf_dir).drop("objects"))
    return boundary.actor_projects(e, boundary.project_issues(e), boundary.actors(e))


def clusters(spark: SparkSession, sf_dir: str) -> dict:
    return mining.cluster_sessions(event_steps(spark, sf_dir).select("session_id", "step", "api"), eps=0.3)


def sequence_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct, _ = mining.sequences(event_steps(spark, sf_dir).select("session_id", "step", "api"))
    n = mining.norms(distinct, mining.vectors(distinct))
    return distinct.join(n, "seq").select(F.array_join("apis", ">").alias("trace"), F.col("n").alias("n_sessions"), F.round("norm", 6).alias("norm"), F.round("len", 6).alias("scaled_length"))


def close_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct, _ = mining.sequences(event_steps(spark, sf_dir).select("session_id", "step", "api"))
    v = mining.vectors(distinct)
    pairs = mining.close_pairs(v, mining.norms(distinct, v), 0.3, distinct.select("seq", F.array_join("apis", ">").alias("name")))
    return pairs.select(F.col("a").alias("left_trace"), F.col("b").alias("right_trace"), F.round("dist", 6).alias("dist"))


def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir)["sessions"]


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir)["summary"]


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.members(clusters(spark, sf_dir))


def nearest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.members(clusters(spark, sf_dir), limit=5)


def noise_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.noise_sessions(clusters(spark, sf_dir))


def first_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_sessions(spark, sf_dir).withColumn("site_id", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")))
    return sessions.chosen(e, "s1", 100).groupBy("site_id", "session_id").agg(F.count("*").alias("session_length"))


def auto_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.cluster_sessions(event_steps(spark, sf_dir).select("session_id", "step", "api"))
    info = found["eps_info"]
    own = [F.lit(round(float(info[c]), 6)).alias(c) for c in ("eps", "raw_eps", "k_distance_min", "k_distance_max", "k_distance_avg")]
    return found["labels"].join(found["distinct"], "seq").agg(*own, F.lit(info["mode"]).alias("mode"), F.count_if(F.col("cluster") >= 0).alias("clustered_sequences"), F.sum(F.when(F.col("cluster") < 0, F.col("n")).otherwise(0)).alias("noise_sessions"))


def part_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as reviewed clusters: every second has a parameter scenario with its own target, the others none of substance."""
    size, even = F.col("p_size").cast("int"), F.col("p_size") % 2 == 0
    listed = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    sequence = F.struct(listed(F.concat(F.lit("GET /type/"), (size % 5).cast("string")), "POST /buy"), empty, none, none, none, empty)
    records = [F.lit(None).cast(f"array<{ddl}>") for ddl in (reviews.OCCURRENCE_DDL, reviews.BINDING_DDL)]
    parameter = F.struct(F.when(even, listed("orderId")).otherwise(empty), F.when(even, listed("POST /pay")).otherwise(empty), empty, none, none, none, empty, *records)
    more = [F.lit(None).cast("double"), *[none for _ in reviews.DETAILS], F.lit(None).cast(f"array<{reviews.ANGLE_DDL}>")]
    scenario = F.struct(none, F.col("p_name"), none, F.lit("low"), none, sequence, parameter, none, F.when(size % 3 == 0, "brandKey changes"), *more)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("cluster_index"), (size % 3 > 0).alias("is_trustworthy"), (size / 50.0).alias("trust_score"), F.col("p_brand").alias("business_pattern_name"), empty.alias("mixed_member_session_ids"), F.array(scenario).cast(f"array<{reviews.SCENARIO_DDL}>").alias("possible_security_scenarios"))
    return p


def context_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = reviews.parameter_blocks(part_reviews(spark, sf_dir))
    return reviews.context_bindings(blocks).groupBy("parameter", "source_api", "target_api", "relation").agg(F.count("*").alias("n"))


def parameter_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = reviews.parameter_blocks(part_reviews(spark, sf_dir))
    return reviews.parameter_occurrences(blocks).groupBy("parameter", "api", "location", "role").agg(F.count("*").alias("n"))


def api_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's riskiest path for a scenario that starts from its first page."""
    c = page_requests(spark, sf_dir).groupBy("site_id", "path").agg(F.min("page_id").alias("at"))
    none = F.array().cast("array<string>")
    entry = F.struct("at", F.concat(F.lit("GET "), "path").alias("api"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("operation_id"), none.alias("parameters"), F.when(F.col("path").contains("{int}"), F.array(F.lit("id"))).alias("object_parameters"), none.alias("sensitive_fields"))
    s = c.groupBy("site_id").agg(F.array_sort(F.collect_list(entry)).alias("context"), F.min(F.struct("at", "path")).alias("first"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("BOLA", "BFLA", "RESOURCE_CONSUMPTION")]), (F.length("site_id") % 3 + 1).cast("int"))
    return rules.risk_api(s.select("site_id", F.concat(F.lit("attack on "), "first.path", F.lit(" search")).alias("text"), kind.alias("security_type"), "context")).select("site_id", "security_type", "api", "score")


def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reviews.summary(reviews.normalise(part_reviews(spark, sf_dir)))
    return s.withColumn("low_trust_cluster_indexes", F.array_join(F.transform("low_trust_cluster_indexes", lambda x: x.cast("string")), ","))


def upstream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many projects and issues each request has among the six before it."""
    e = object_events(spark, sf_dir)
    return e.groupBy(F.size("upstream_projects").alias("projects_before"), F.size("upstream_issues").alias("issues_before")).agg(F.count("*").alias("n"))


QUERIES = (
    gateway_events, gateway_counts, session_gap, session_gap_default, session_capped, session_length_hist, session_stream, first_sessions, dfg_edges, skip_edges, role_edges, trace_summary,
    url_template, method_profile, parameter_profile, parameter_sets, request_samples, top_paths, site_totals, header_profile, path_parameters, openapi_paths, openapi_index, openapi_merge, value_typing,
    label_left_join, label_counts, label_semi, label_anti, time_window, rule_hits, findings_by_rule, rule_evidence, rule_run_summary, request_values, business_focus, noise_overlap,
    boundary_relations, project_support, actor_access, upstream_window, sequence_norms, close_sequences, dbscan_labels, cluster_summary, cluster_members, nearest_members, noise_sessions, auto_eps, review_summary, context_bindings, parameter_occurrences, api_risk,
)
