"""Queries over written logs: events, pages, parts and orders as lines of files that are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.functions import params, times
from weftlog.functions import text as t
from weftlog.operators import events as log
from weftlog.operators import boundary, detection, labeling, mining, profile, reviews, sessions
from weftlog.operators.graph import shared_dir, written
from weftlog.plans.queries import EVIDENCE, IDLE, actor_access, boundary_relations, clusters, demo_rules, event_steps, event_values, events, page_requests, part_reviews, table
from weftlog.sources import readers, writers


def lines_in_files(df: DataFrame) -> str:
    """The path of a folder with ``value`` as text files."""
    path = f"{shared_dir(df.sparkSession)}/weftlog-lines-{uuid.uuid4().hex}"
    df.select("value").write.text(path)
    return path


def spread(steps: DataFrame) -> DataFrame:
    """Event steps with site, label and token of their sessions."""
    label = F.max(F.col("event_type") == "error").over(Window.partitionBy("user_id", "segment"))
    return steps.withColumns({"site_id": (F.col("user_id") % 3).cast("string"), "session_label": F.when(label, "abnormal").otherwise("normal"), "token": F.format_string("GET /%s/%s?k=1", "event_type", F.coalesce(F.col("k").cast("string"), F.lit("none")))})


def all_session_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as traces (even users) and as objects of three kinds (odd ones), read back as one table."""
    s = spread(event_steps(spark, sf_dir))
    traced = s.filter("user_id % 2 = 0").withColumn("token", F.concat("token", F.lit(" [200] ms=3 action=pass")))
    text = writers.trace_text(traced).select(F.concat(F.regexp_replace("value", r"\n(Step 2:)", "\n\n  \nnoise\n$1"), F.lit("Step 99: \n")).alias("value"))
    entry = F.struct("step", "token", F.when(F.col("step") % 3 == 0, F.col("token")).alias("full"), F.when(F.col("step") % 3 != 1, F.lit("GET /other")).alias("own"))
    o = s.filter("user_id % 2 = 1").groupBy("session_id", "user_id", "site_id", "session_label").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    full, short = F.transform("e", lambda x: x["token"]), F.flatten(F.transform("e", lambda x: F.array(F.lit(" "), F.concat(F.lit("  "), x["token"]))))
    steps = F.map_from_entries(F.transform("e", lambda x: F.struct(x["step"].cast("string"), F.struct(x["full"].alias("full_api_request"), F.when(x["full"].isNull(), x["own"]).alias("token"), F.when(x["full"].isNull() & x["own"].isNull(), x["token"]).alias("api_request_pattern")))))
    way = F.col("user_id") % 5
    objects = o.select(F.to_json(F.struct("session_id", F.when(way != 0, F.col("site_id")).alias("site_id"), "session_label", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client_key"), F.when(way < 2, full).alias("full_api_sequence"), F.when(way < 4, short).alias("api_sequence"), steps.alias("sequence"))).alias("value"))
    read = readers.all_steps(readers.json_blocks(spark, lines_in_files(objects)), readers.trace_steps(spark, lines_in_files(text), "t"))
    return read.select("site_id", "session_id", "session_label", F.coalesce("source_ip", F.lit("")).alias("source_ip"), "step", "token")


def line_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines with times of many spellings, bad times and bad JSON among them: every line with its reason and time."""
    at = F.timestamp_seconds(F.floor("sec"))
    shown = lambda pattern: F.date_format(at, pattern)
    spelt = F.element_at(F.array(
        shown("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), shown("yyyy-MM-dd'T'HH:mm:ss"), shown("yyyy-MM-dd HH:mm:ss"), F.concat(shown("yyyy-MM-dd"), F.lit("T24:00:00Z")),
        F.concat(shown("yyyy-MM-dd"), F.lit("T:"), shown("mm:ss")), shown("yyyy-MM-dd'T'HH:mm:ss.'250000Z'"), F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit("|late"))), (F.col("event_id") % 12 - 3).cast("int"))
    record = F.concat(F.lit('{"timestamp": "'), spelt, F.lit('", "event_id": '), F.col("event_id").cast("string"), F.lit("}"))
    way = F.col("event_id") % 12
    line = F.when(way == 0, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))).when(way == 1, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))).when(way == 2, F.concat(F.lit('{"timestamp": "soon", "event_id": '), F.col("event_id").cast("string"), F.lit("} "))).when(way == 3, F.concat(F.lit('  {"event_id": '), F.col("event_id").cast("string"), F.lit("}"))).otherwise(record)
    read = readers.tagged_lines(spark, lines_in_files(events(spark, sf_dir).select(line.alias("value"))), "timestamp string, event_id bigint", times.log_time)
    return read.select("line", "reason", F.coalesce("record.event_id", F.lit(-1)).alias("event_id"), F.coalesce(F.unix_millis("time"), F.lit(-1)).alias("at_ms"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lines of all kinds: access, security and other tags, times near a day's end, objects and plain text."""
    page = F.col("page_id")
    tag = F.when(page % 5 == 0, "tag:waf_log_websec").when(page % 5 < 4, "tag:waf_log_webaccess").otherwise("tag:other")
    time = F.element_at(F.array(*[F.lit(x) for x in ("2026-06-15T24:00:00+08:00", "2026-06-16T07:59:59", "2026-06-16T00:00:00Z", "2026-06-16T23:00:00+08:00", "2026-06-15T23:59:59+08:00", "today")]), (page % 6 + 1).cast("int"))
    msg = F.format_string("%s;request_id:r%s;event_type:%s;url:/p/%s", tag, page, F.element_at(F.array(F.lit("none"), F.lit(""), F.lit("sqli")), (page % 3 + 1).cast("int")), page)
    line = F.concat(F.lit('{"timestamp":"'), time, F.lit('","msg":"'), msg, F.when(page % 7 == 0, '"} tail').otherwise('"}'))
    return table(spark, sf_dir, "pages").select("page_id", line.alias("value"))


def routed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one day by their tag, labelled, with the type of their event set to what the label says."""
    lines = readers.log_lines(spark, lines_in_files(page_lines(spark, sf_dir)))
    time = times.iso_time(F.regexp_extract("value", r'"timestamp"\s*:\s*"([^"]+)"', 1))
    day = [F.lit(x).cast("timestamp") for x in ("2026-06-15T16:00:00Z", "2026-06-16T15:00:00Z")]
    kept = labeling.in_window(lines.withColumn("time", time), "time", *day)
    rid = F.regexp_extract("value", r'request_id:([^;"\s]+)', 1)
    named = F.trim(F.regexp_extract("value", r"event_type:([^;]+)", 1))
    label = F.when(named == "sqli", 1).otherwise(0)
    out = writers.append_fields(t.replace_first_field(F.col("value"), "event_type", F.when(label == 1, "attack").otherwise("none")), label=label, matched_request_id=rid)
    return kept.select(labeling.tag_of(F.col("value"), "tag:waf_log_webaccess", "tag:waf_log_websec").alias("route"), rid.alias("request_id"), named.alias("event_type"), out.alias("line"))


def gateway_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as gateway lines whose requests are encoded without padding, carry JSON, or lack a URL; static files and health checks among them."""
    page, target = F.col("page_id"), F.regexp_replace("raw_url", r"^[a-z]+://[^/?#]*", "")
    json_body = F.format_string('{"id":%s,"user":{"name":"u%s","tags":["a",true,null]},"ok":false}', page, page)
    request = F.concat(F.lit("PUT "), target, F.lit(" HTTP/1.1\r\nHost: x\r\n\r\n"), json_body)
    sent = F.regexp_replace(F.base64(request.cast("binary")), r"[\r\n=]", "")
    how = (
        F.when(page % 6 == 0, F.concat(F.lit("http:"), sent)).when(page % 6 == 1, F.concat(F.lit("url:/"), target)).when(page % 6 == 2, "method:get").when(page % 6 == 3, "url:/a/b/Logo.PNG?v=2")
        .when(page % 6 == 4, "url:/healthz/live").otherwise(F.concat(F.lit("method:delete;uri:"), target, F.lit(";url: ")))
    )
    line = F.concat(F.lit("request_id:r"), page.cast("string"), F.lit(";src_ip:"), F.when(page % 4 == 0, "").otherwise(F.format_string("192.0.2.%s", page % 200)), F.lit(";"), how)
    return page_requests(spark, sf_dir).select(F.when(page % 2 == 0, F.to_json(F.struct(line.alias("message")))).otherwise(line).alias("value"))


def gateway_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of those lines, as events written by site and as rejects, both read back."""
    parsed = written(log.parse_lines(gateway_variants(spark, sf_dir)))  # parsed once for both
    base = f"{shared_dir(spark)}/weftlog-events-{uuid.uuid4().hex}"
    writers.write_events(log.dynamic_events(parsed), f"{base}/events")
    writers.write_rejects(parsed, f"{base}/rejects")
    kept = spark.read.parquet(f"{base}/events").select(F.lit("ok").alias("reason"), "request_id", "method", "path", "source_ip", F.array_join("body_param_names", ",").alias("body_names"), "body_param_type_pattern")
    bad = spark.read.schema("reason string, raw string").json(f"{base}/rejects").select("reason", F.regexp_extract("raw", r"request_id:(r\d+)", 1).alias("request_id"), *[F.lit("").alias(c) for c in ("method", "path", "source_ip", "body_names", "body_param_type_pattern")])
    return kept.union(bad)


def client_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of clients that are named in one of three fields or nowhere: sessions with their ids."""
    e = events(spark, sf_dir)
    user = F.col("user_id").cast("string")
    named = {c: F.when(F.col("user_id") % 4 == i, F.concat(F.lit(c[0]), user)).otherwise(F.lit(" ") if i else F.lit(None).cast("string")) for i, c in enumerate(("raw_client_ip", "source_ip", "src_ip"))}
    e = e.withColumns(named).withColumns({"client_key": sessions.client_key(), "site_id": (F.col("user_id") % 2).cast("string")})
    s = sessions.by_gap(e, ["site_id", "client_key"], "sec", ["event_id"], 600)
    per = s.groupBy("site_id", "client_key", "segment").agg(F.min("sec").alias("start"), F.count("*").alias("session_length"))
    return per.select(sessions.session_id("site_id", "client_key", "start", "segment").alias("session_id"), "client_key", "session_length")


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of orders as nested JSON, in the four dialects, with how often each path and value occurs."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 4).alias("part"))
    items = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int") + 20), lambda i: i)
    body = F.format_string('{"status":"%s","items":%s,"more":{"flag":%s,"none":null,"empty":[],"list":[{"a":%s},[1,"x"]]},"n":-%s}', "o_orderstatus", F.to_json(items), (F.col("o_orderkey") % 2 == 0).cast("string"), "part", F.col("o_orderkey") % 5)
    dialects = {"event": params.EVENT, "profile": params.PROFILE, "boundary": params.BOUNDARY, "detection": params.DETECTION}
    found = F.array(*[F.struct(F.lit(n).alias("dialect"), params.body_pairs(F.col("body"), d).alias("pairs")) for n, d in dialects.items()])
    # equal bodies have equal leaves, so each is flattened once
    rows = o.groupBy(body.alias("body")).agg(F.count("*").alias("times")).select("times", F.explode(found).alias("d")).select("times", "d.dialect", F.explode("d.pairs").alias("p"))
    return rows.groupBy("dialect", F.col("p.name").alias("name"), F.col("p.value").alias("value")).agg(F.sum("times").alias("n"))


def scenario_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, types and risks of the parts' scenarios once normalised, with the reviews' warnings and shared names."""
    s = reviews.mark_duplicates(reviews.normalise(part_reviews(spark, sf_dir)))
    rows = s.select("cluster_index", F.array_join("warnings", ",").alias("warnings"), "name_count", F.explode_outer("possible_security_scenarios").alias("s"))
    text = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit("")).alias(c)
    return rows.select("cluster_index", "warnings", "name_count", text("scenario_title"), text("security_type"), text("risk_type"))


def answer_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a reviewer with words around them, cut short, doubled, or none at all: the reviews in them."""
    key = F.col("p_partkey")
    whole = F.format_string('{"cluster_index": %s, "is_trustworthy": %s, "trust_score": 0.5, "business_pattern_name": "a {%s}"}', key, (key % 2 == 0).cast("string"), "p_brand")
    answer = F.element_at(F.array(whole, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```")), F.substring(whole, F.lit(1), F.length(whole) - 1), F.concat(whole, F.lit(" and "), whole), F.lit("no answer")), (key % 5 + 1).cast("int"))
    return reviews.parse_answers(table(spark, sf_dir, "part").select(answer.alias("answer"))).select("cluster_index", "is_trustworthy", "business_pattern_name")


def cluster_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as traces of clusters: those long enough for a review, cut to a head and a tail."""
    e = events(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "event_type"))), lambda x: x["event_type"]).alias("trace"))
    fits, short = reviews.reviewable(e.withColumn("representative_length", F.size("trace")), least=10)
    cut = fits.select("user_id", F.lit("review").alias("kind"), F.array_join(reviews.trim_trace(F.col("trace"), 14, 9, 4), ">").alias("trace"))
    return cut.union(short.select("user_id", F.lit("short"), F.array_join("trace", ">")))


def session_gap_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_gap`` with the users' events split by hours and stitched."""
    s = sessions.by_gap_wide(events(spark, sf_dir), ["user_id"], "sec", ["event_id"], IDLE, span=3600.0)
    return sessions.summaries(s, ["user_id"], ["segment"], "us", ["event_id"], F.col("event_type") == "error")


def session_gap_one_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as those of one client, cut into sessions by every task."""
    e = events(spark, sf_dir).withColumn("client", F.lit("proxy"))
    return sessions.by_gap_wide(e, ["client"], "sec", ["event_id"], 30, span=3600.0).groupBy("client", "segment").agg(F.count("*").alias("session_length"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


def project_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten widest projects with their five most frequent issues."""
    rows = boundary.widest(boundary_relations(spark, sf_dir), "project", "issue", top_items=5, limit=10)
    return rows.select("project", "support", "issue_count", F.array_join(F.transform("issues", lambda x: F.concat_ws("*", x["value"], x["count"].cast("string"))), ",").alias("issues"))


def actor_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actors with enough support and their three most frequent projects."""
    rows = boundary.widest(actor_access(spark, sf_dir), "actor", "project", top_items=3, limit=25)
    return rows.select("actor", "support", "project_count", F.array_join(F.transform("projects", lambda x: F.concat_ws("*", x["value"], x["count"].cast("string"))), ",").alias("projects"))


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with all that a report tells of them: the rule's scenario, the client, and the requests as sent."""
    s = event_steps(spark, sf_dir)
    steps = written(s.select("session_id", "step", "api", "k", F.concat(F.lit("GET /"), "api", F.lit("?k="), F.coalesce(F.col("k").cast("string"), F.lit(""))).alias("token"), F.concat(F.lit("192.0.2."), (F.col("user_id") % 250).cast("string")).alias("source_ip"), (F.col("user_id") % 3).alias("dropped")))
    used = detection.active(demo_rules(spark))
    source = F.struct("source.scenario_id", F.concat(F.lit("title of "), "fol_id").alias("scenario_title"), F.lit("BOLA").alias("security_type"), F.lit("shop").alias("business_pattern_name"))
    summary = F.struct(F.when(F.col("fol_id") == "R2", "BFLA").alias("security_type"), F.when(F.col("fol_id") != "R3", "high").alias("risk_level"), F.concat(F.lit("reason of "), "fol_id").alias("overall_reason"))
    rules = used.withColumns({"source": source, "scenario_summary": summary})
    hits = written(detection.detect(steps, event_values(steps), detection.expressions(used)))
    found = detection.session_findings(detection.capped_evidence(hits, EVIDENCE), steps, rules)
    shown = F.array_join(F.transform("expression_hits", lambda h: F.concat_ws("@", h["reason"], h["step"].cast("string"))), ",")
    return found.select("fol_id", "session_id", *detection.TOLD, "source_ip", F.array_join("raw_sequence", " ").alias("requests"), F.array_join("api_sequence", ">").alias("trace"), shown.alias("hits"), F.col("filtered_noise_count").cast("bigint").alias("filtered_noise_count"))


def refreshed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, written three times: stale ones first, then the true ones twice over; and once more by what is not finished."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    base = f"{shared_dir(spark)}/weftlog-orders-{uuid.uuid4().hex}"
    writers.refresh(o.withColumn("o_totalprice", F.lit(0.0)), f"{base}/all", "o_orderstatus")
    for _ in range(2):
        writers.refresh(o.filter("o_orderstatus != 'P'"), f"{base}/all", "o_orderstatus")
    for some in (o.filter("o_orderstatus = 'F'"), o.withColumn("o_totalprice", -F.col("o_totalprice")), o):
        writers.refresh_new(some, f"{base}/new", f"{base}/finished", "o_orderstatus")
    rows = [spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").parquet(f"{base}/{way}").withColumn("way", F.lit(way)) for way in ("all", "new")]
    return rows[0].union(rows[1]).groupBy("way", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def log_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' sample requests as they are shown, odd ones with a body that has a secret and a repeated name."""
    p = page_requests(spark, sf_dir)
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    page = F.col("page_id")
    body = F.when(page % 2 == 1, F.array(pair("page", F.lit("old")), pair("password", page), pair("page", page), pair("note", F.lit("n" * 300)))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    shown = profile.log_sample(F.concat(F.lit("GET "), "full_path"), F.when(page % 3 > 0, "get"), F.col("query"), F.when(page % 4 > 0, 200 + page % 4), F.lit("text/html"), F.lit(None).cast("string"), body)
    return profile.samples(p, "page_id").select("site_id", "path", "page_id", F.col("at").alias("sample_no"), F.to_json(shown).alias("sample"))


def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the sessions' run, with the lines that were rejected before it."""
    e = events(spark, sf_dir)
    bad = e.select(F.when(F.col("event_id") % 40 == 0, "bad_json").when(F.col("event_id") % 40 == 1, "bad_time").otherwise("ok").alias("reason"), "*")
    s = sessions.by_gap(bad.filter("reason = 'ok'").drop("reason"), ["user_id"], "sec", ["event_id"], IDLE)
    return sessions.run_report(sessions.summaries(s, ["user_id"], ["segment"], "us", ["event_id"], F.col("event_type") == "error"), bad)


def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest clusters."""
    return mining.largest_clusters(clusters(spark, sf_dir)["summary"], 2)


def later_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that an earlier run, which wrote every user's first one by site as JSON lines, does not have."""
    e = events(spark, sf_dir).withColumn("at", F.timestamp_micros("us"))
    s = sessions.by_gap(e, ["user_id"], "sec", ["event_id"], IDLE)
    s = s.groupBy("user_id", "segment").agg(times.epoch_seconds(F.min("at")).alias("start"), F.count("*").alias("session_length"))
    path = f"{shared_dir(spark)}/weftlog-sessions-{uuid.uuid4().hex}"
    writers.write_by(s.filter("segment = 0").withColumn("site_id", F.col("user_id") % 3), "site_id", path, "json")
    known = readers.json_lines(spark, path, "user_id bigint, segment bigint, session_length bigint")
    return writers.new_rows(s, known, ["user_id", "segment"]).select("user_id", "segment", "session_length", F.floor(F.col("start") * 1000).alias("start_ms"))


QUERIES = (later_sessions, log_samples, session_report, top_clusters, session_gap_wide, session_gap_one_client, project_tops, actor_tops, rule_findings, refreshed_orders, all_session_steps, line_reasons, routed_lines, gateway_bodies, client_sessions, json_leaves, scenario_titles, answer_reviews, cluster_briefs)
