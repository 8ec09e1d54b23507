"""Gateway lines to typed API events: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.functions import text as t
from weftlog.functions import url as u
from weftlog.functions.params import body_pairs

#: Fixed value: the tag of security records.
SECURITY_TAG = "waf_log_websec"
PLAIN = ("waf_status_code", "action", "alertlevel", "event_type", "request_id")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Each line (``value``) with the event's columns and ``reason``: ok or missing_url.

    The decoded request line outranks the URL fields, and the method field the request line. A status that is
    no number is null.
    """
    df = lines.withColumn("fields", t.semicolon_fields(t.message(F.col("value"))))
    f = lambda k: t.field(F.col("fields"), k)
    o = lambda k: F.get_json_object("value", f"$.{k}")
    df = df.withColumn("http", t.base64_text(t.first_nonempty(f("http"), o("http"))))
    df = df.withColumn("raw_url", u.clean_target(t.first_nonempty(t.request_target(F.col("http")), f("url"), f("uri"), o("url"), o("uri"))))
    df = df.withColumn("path", u.percent_decode(u.target_path(F.col("raw_url"))))
    df = df.withColumn("query", u.percent_decode(u.raw_query(F.col("raw_url"))))
    df = df.withColumns({
        "reason": F.when(F.coalesce("path", F.lit("")) == "", "missing_url").otherwise("ok"),
        "timestamp": t.first_nonempty(f("stat_time"), o("stat_time"), o("timestamp")),
        "site_id": t.first_nonempty(f("site_id"), o("site_id"), F.lit("unknown_site")),
        "tag": t.first_nonempty(f("tag"), o("tag")),
        "raw_client_ip": t.first_nonempty(f("raw_client_ip"), o("raw_client_ip")),
        "src_ip": t.first_nonempty(f("src_ip"), o("src_ip"), o("source_ip")),
        "method": F.upper(t.first_nonempty(f("method"), o("method"), t.request_method(F.col("http")), F.lit("GET"))),
        "status_code": t.first_nonempty(f("ser_status_code"), o("ser_status_code"), F.lit("0")).try_cast("int"),
        **{k: t.first_nonempty(f(k), o(k)) for k in PLAIN},
        "path_pattern": u.path_template(F.col("path")), "url_type": u.path_class(F.col("path")),
        "param_pairs": u.query_pairs(F.col("query")), "body_param_pairs": body_pairs(t.request_body(F.col("http"))),
    })
    df = df.withColumns({
        "source_ip": t.first_nonempty(F.col("raw_client_ip"), F.col("src_ip"), F.lit("unknown_ip")),
        "event_label": F.when(F.col("tag") == SECURITY_TAG, "abnormal").otherwise("normal"),
        **{f"{p}param_{k}": v for p in ("", "body_") for k, v in (("names", F.transform(f"{p}param_pairs", lambda x: x["name"])), ("name_set", t.name_set(F.col(f"{p}param_pairs"))), ("count", F.size(f"{p}param_pairs")), ("type_pattern", t.type_pattern(F.col(f"{p}param_pairs"))))},
        "repeated_params": t.repeated_names(F.col("param_pairs")), "body_repeated_params": t.repeated_names(F.col("body_param_pairs")),
    })
    request = lambda path, query: F.concat_ws(" ", "method", u.join_query(F.col(path), F.col(query)))
    return df.withColumns({"api_request": request("path", "query"), "api_request_pattern": request("path_pattern", "param_type_pattern"), "api_request_param_names": request("path_pattern", "param_name_set")}).drop("fields", "http")


def dynamic_events(parsed: DataFrame, keep_static: bool = False) -> DataFrame:
    """Parsed lines that are events; static files and health checks only if asked for."""
    ok = parsed.filter("reason = 'ok'")
    return ok if keep_static else ok.filter("url_type = 'dynamic_request'")


def sequence_tokens(events: DataFrame) -> DataFrame:
    """``token`` (template and types) and ``full_request`` (as sent), each with its body part."""
    body_types = F.coalesce(F.nullif("body_param_type_pattern", F.lit("")), F.nullif("body_param_name_set", F.lit("")))
    sent = F.filter("body_param_pairs", lambda p: F.coalesce(p["name"], F.lit("")) != "")
    body = F.nullif(F.array_join(F.transform(sent, lambda p: F.concat_ws("=", p["name"], F.coalesce(p["value"], F.lit("")))), "&"), F.lit(""))
    with_body = lambda base, extra: F.concat(base, F.coalesce(F.concat(F.lit(" BODY "), extra), F.lit("")))
    return events.withColumns({"token": with_body(F.col("api_request_pattern"), body_types), "full_request": with_body(F.col("api_request"), body)})


def run_counts(parsed: DataFrame) -> DataFrame:
    """Counts of a run: reasons, kinds of URL dropped, events with query and with body parameters."""
    kept = (F.col("reason") == "ok") & (F.col("url_type") == "dynamic_request")
    return parsed.agg(
        F.count_if(F.col("reason") == "ok").alias("ok"), F.count_if(F.col("reason") == "missing_url").alias("missing_url"),
        F.count_if((F.col("reason") == "ok") & (F.col("url_type") == "static_resource")).alias("static_resource"), F.count_if((F.col("reason") == "ok") & (F.col("url_type") == "health_check")).alias("health_check"),
        F.count_if(kept & (F.col("query") != "")).alias("with_query"), F.count_if(kept & (F.col("body_param_count") > 0)).alias("with_body_params"),
    )
