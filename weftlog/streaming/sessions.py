"""Sessions of a stream: the batch operator's idle-gap rule on Structured Streaming's session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, keys: list[str], ts: str, idle: str = "10 minutes", late: str = "1 hour", abnormal=None) -> DataFrame:
    """One row per closed session: start, end, length and label. Events later than ``late`` are dropped.

    As in the batch, a gap equal to ``idle`` still belongs to the session. Works on a static table too.
    """
    bad = F.lit(False) if abnormal is None else abnormal
    window = F.session_window(ts, idle)
    out = events.withWatermark(ts, late).groupBy(*keys, window).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("session_length"), F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    return out.withColumn("session_label", F.when(F.col("bad"), "abnormal").otherwise("normal")).drop("session_window", "bad")
