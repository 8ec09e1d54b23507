"""Readers of log lines, JSON blocks and compact traces. Each file is split and read on the executors."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlog.functions.text import clean_token, is_object, strip
from weftlog.functions.url import request_api

#: Fixed value: a header of a compact trace.
TRACE_HEADER = r"^===\s+(.*?)\s*==="

SESSION_DDL = "site_id string, client_key string, source_ip string, raw_client_ip string, src_ip string, session_id string, session_label string, session_length int, start_time string, end_time string, api_sequence array<string>, full_api_sequence array<string>, sequence map<string, struct<timestamp: string, method: string, raw_url: string, full_api_request: string, api_request_pattern: string, path: string, path_pattern: string, query: string, token: string, status_code: int, event_label: string, request_id: string>>"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines (gzip by suffix) with their file; ``value`` is trimmed."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    return lines.filter("value != ''")


def tagged_lines(spark: SparkSession, path: str, schema: str, time: Callable[[Column], Column]) -> DataFrame:
    """Lines of objects, good or not, in one pass: ``line``, ``record``, ``time`` and ``reason``.

    ``reason`` is ``bad_json`` for a line that is no object, ``bad_time`` for one whose time ``time`` (of the record's
    timestamp) gives null, else ``ok``. Nothing is dropped but blank lines; a record of a bad line is null.
    """
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line")).filter("line != ''")
    rows = lines.withColumn("object", is_object(F.col("line"))).withColumn("record", F.when(F.col("object"), F.from_json("line", schema)))
    rows = rows.withColumn("time", time(F.coalesce("record.timestamp", F.lit(""))))
    return rows.select("line", "record", "time", F.when(~F.col("object"), "bad_json").when(F.col("time").isNull(), "bad_time").otherwise("ok").alias("reason"))


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line; lines that are no object are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_blocks(spark: SparkSession, path: str, schema: str | StructType = SESSION_DDL) -> DataFrame:
    """Objects parted by blank lines (pretty-printed or not), one object a file included, or one a line.

    A block whose first line is a whole object is read line by line; what is no object is dropped.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    first = F.substring_index(F.ltrim("value"), "\n", 1)
    lines = F.when(is_object(first), F.split("value", "\n")).otherwise(F.array("value"))
    parts = blocks.select("file", F.explode(lines).alias("value"))
    parts = parts.filter(is_object(strip(F.col("value"))))
    return parts.select("file", F.from_json("value", schema).alias("o")).select("o.*", "file")


def trace_steps(spark: SparkSession, path: str, site_id: str = "") -> DataFrame:
    """Compact traces in long form: file, session_id, session_name, session_label, site_id, step, token.

    A header ``=== text ===`` begins a session, whose id is the whole text with ``_`` for spaces; ``session_name`` and
    ``session_label`` are its words after ``Session`` and ``Label:``. Steps before any header, and under an empty one,
    belong to ``<site>_txt_<number of headers so far>``. Blank and other lines do not count. Steps are cleaned, those
    that become empty are left out, and the rest numbered anew. Without ``site_id`` the file's name has the site.

    State crosses lines, so it is carried in two levels: running counts within each split of a file, and then over the
    splits, of which a file has few; no task needs a whole file.
    """
    raw = spark.read.text(path).select(strip(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    token = clean_token(F.regexp_extract("line", r"^Step\s+\d+:\s+(.+)$", 1), body=True)
    marked = raw.select("file", "split", "at", F.when(F.col("line").rlike(TRACE_HEADER), F.regexp_extract("line", TRACE_HEADER, 1)).alias("header"), F.nullif(token, F.lit("")).alias("token"))
    here = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = marked.filter("header is not null or token is not null").withColumns({"headers": F.count("header").over(here), "steps": F.count("token").over(here), "head": F.last("header", ignorenulls=True).over(here)})
    lines = lines.withColumn("head_steps", F.max(F.when(F.col("header").isNotNull(), F.col("steps"))).over(here))
    totals = lines.groupBy("file", "split").agg(F.max("headers").alias("all_headers"), F.max("steps").alias("all_steps"), F.max_by("head", "at").alias("last_head"), F.max("head_steps").alias("last_head_steps"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"headers_before": F.coalesce(F.sum("all_headers").over(earlier), F.lit(0)), "steps_before": F.coalesce(F.sum("all_steps").over(earlier), F.lit(0)), "head_before": F.last("last_head", ignorenulls=True).over(earlier)})
    totals = totals.withColumn("head_steps_before", F.max(F.col("steps_before") + F.col("last_head_steps")).over(earlier))
    carried = totals.select("file", "split", "headers_before", "steps_before", "head_before", "head_steps_before")
    s = lines.filter("token is not null").join(carried, ["file", "split"])
    s = s.withColumns({"number": F.col("headers_before") + F.col("headers"), "head": F.coalesce("head", "head_before", F.lit("")), "step": F.col("steps_before") + F.col("steps") - F.coalesce(F.col("steps_before") + F.col("head_steps"), "head_steps_before", F.lit(0))})
    site = F.lit(site_id) if site_id else site_of(F.col("file"))
    return s.select(
        "file", F.coalesce(F.nullif(F.replace("head", F.lit(" "), F.lit("_")), F.lit("")), F.concat_ws("_", site, F.lit("txt"), F.col("number").cast("string"))).alias("session_id"),
        F.regexp_extract("head", r"^Session\s+(\S+)", 1).alias("session_name"), F.regexp_extract("head", r"Label:(\S+)", 1).alias("session_label"), site.alias("site_id"), F.col("step").cast("int").alias("step"), "token",
    )


def discover(spark: SparkSession, folder: str, site_id: str = "", bucket: str = "all") -> DataFrame:
    """Session files under a folder: file and site_id.

    They are named ``session_site_<id>.jsonl`` or ``..site_<id>.txt``. Those in the folder itself count; if there are
    none, those in the folder's ``bucket``; if there are none there either, all below. ``site_id`` keeps one site's. The
    names alone are listed, no file is read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    below = F.regexp_replace("path", "^.*?" + re.escape(folder.split(":", 1)[-1].rstrip("/")) + "/", "")
    files = listed.select(F.col("path").alias("file"), site_of(F.col("path")).alias("site_id"), below.alias("below"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    files = files.filter(F.col("name").rlike(r"^session_site_.*\.jsonl$|site_.*\.txt$"))
    files = files.filter(F.col("site_id") == site_id) if site_id else files
    level = F.when(F.col("below") == F.col("name"), 0).when(F.lit(bucket != "all") & (F.col("below") == F.concat_ws("/", F.lit(bucket), "name")), 1).otherwise(2)
    files = files.withColumn("level", level)
    nearest = files.agg(F.min("level").alias("nearest"))  # one row
    return files.crossJoin(F.broadcast(nearest)).filter((F.col("level") == F.col("nearest")) | (F.col("nearest") == 2)).select("file", "site_id")


def site_of(file: Column) -> Column:
    """Site id in a file name: what stands between the last ``site_`` and the next ``_`` or the suffix."""
    stem = F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.when(F.contains(stem, F.lit("site_")), F.substring_index(F.regexp_extract(stem, r"^.*site_(.*)$", 1), "_", 1)).otherwise("unknown_site")


def session_steps(sessions: DataFrame) -> DataFrame:
    """Long form of session objects: the full requests if there are any, else the templates, else the step map.

    An entry of the map is its full request, else its token, else its template, in order of its number. Blank entries
    are left out and the rest numbered from 1. The API is the token's; a session without a site or an address has
    ``unknown_site`` and its client key.
    """
    told = lambda e: F.coalesce(*[F.nullif(e["value"][c], F.lit("")) for c in ("full_api_request", "token", "api_request_pattern")], F.lit(""))
    by_number = F.transform(F.array_sort(F.transform(F.map_entries("sequence"), lambda e: F.struct(e["key"].try_cast("int").alias("n"), told(e).alias("t")))), lambda e: e["t"])
    filled = lambda c: F.when(F.size(c) > 0, c)
    tokens = F.coalesce(filled(F.col("full_api_sequence")), filled(F.col("api_sequence")), filled(by_number))
    tokens = F.filter(F.transform(tokens, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    or_else = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c[:-1]], F.lit(c[-1]))
    rows = sessions.select(or_else("site_id", "unknown_site").alias("site_id"), or_else("session_id", "").alias("session_id"), "session_label", or_else("source_ip", "client_key", "").alias("source_ip"), or_else("start_time", "").alias("start_time"), or_else("end_time", "").alias("end_time"), F.posexplode(tokens).alias("pos", "token"))
    return rows.withColumns({"step": F.col("pos") + 1, "api": request_api(F.substring_index(clean_token(F.col("token"), body=True), "?", 1))}).drop("pos")


def all_steps(objects: DataFrame, traces: DataFrame) -> DataFrame:
    """Both kinds of sessions in one long table; sessions without steps do not occur."""
    return session_steps(objects).unionByName(traces.drop("file"), allowMissingColumns=True)
