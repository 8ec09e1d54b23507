"""Sinks: partitioned tables, rejects, traces and labelled lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REJECT_CHARS = 2000


def write_events(parsed: DataFrame, path: str) -> None:
    """Events as a table partitioned by site."""
    parsed.filter("reason = 'ok'").drop("reason", "value").write.partitionBy("site_id").parquet(path)


def write_rejects(parsed: DataFrame, path: str) -> None:
    """Rejected lines with the reason and their first characters."""
    parsed.filter("reason != 'ok'").select("reason", F.substring("value", 1, REJECT_CHARS).alias("raw")).write.json(path)


def write_by(df: DataFrame, column: str, path: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).partitionBy(column).save(path)


def trace_text(steps: DataFrame) -> DataFrame:
    """One text block per session: header, numbered steps, blank line."""
    blocks = steps.groupBy("session_id", "session_label").agg(F.array_sort(F.collect_list(F.struct("step", "token"))).alias("steps"))
    body = F.array_join(F.transform("steps", lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s["token"])), "\n")
    head = F.concat(F.lit("=== Session "), "session_id", F.lit(" Label:"), "session_label", F.lit(" Length:"), F.size("steps").cast("string"), F.lit(" ===\n"))
    return blocks.select(F.concat(head, body, F.lit("\n")).alias("value"))


def append_fields(line: Column, **fields: Column) -> Column:
    """The line as JSON with more fields: spliced before its last brace, else wrapped with the line as ``raw_line``.

    Only line ends are cut off it, so that a line with blanks behind its brace is wrapped. An empty object becomes
    one of the new fields alone.
    """
    extra = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    bare = F.regexp_replace(line, r"\n+$", "")
    spliced = F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(","), F.substring(extra, F.lit(2), F.length(extra)))
    wrapped = F.to_json(F.struct(bare.alias("raw_line"), *[v.alias(k) for k, v in fields.items()]))
    return F.when(bare.rlike(r"^\s*\{\s*\}$"), extra).when(bare.endswith("}"), spliced).otherwise(wrapped)


def new_rows(fresh: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the earlier output does not have yet."""
    return fresh.join(existing.select(*keys).distinct(), keys, "left_anti")


def refresh(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` by ``by``: its partitions replace those that are there, others stay, so that a rerun never doubles rows.

    Rows without a value of ``by`` go to a partition of their own.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def finish(done: DataFrame, manifest: str, by: str) -> None:
    """Note the partitions of ``done`` as finished, after they are written; noting them again changes nothing that is read."""
    done.select(F.col(by).cast("string").alias("part")).distinct().write.mode("append").parquet(manifest)


def unfinished(df: DataFrame, manifest: str | None, by: str) -> DataFrame:
    """The rows of ``df`` whose partition no earlier run has finished; all of them without a manifest (None)."""
    if manifest is None:
        return df
    known = df.sparkSession.read.schema("part string").parquet(manifest).distinct()
    return df.join(known, F.col(by).cast("string").eqNullSafe(F.col("part")), "left_anti")


def refresh_new(df: DataFrame, path: str, manifest: str, by: str) -> None:
    """Write only the partitions that no earlier run has finished, then note them.

    A run that is lost before its note leaves partitions that the next one replaces.
    """
    fs = df.sparkSession._jvm.org.apache.hadoop.fs.Path(manifest)
    there = fs.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(fs)
    new = unfinished(df, manifest if there else None, by)
    refresh(new, path, by)
    finish(new, manifest, by)
