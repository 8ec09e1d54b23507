"""Sessions of events by idle gap, with optional caps on duration and length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDLE, MAX_SECONDS, MAX_EVENTS = 600, 7200, 500


def client_key() -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("raw_client_ip", "source_ip", "src_ip")], F.lit("unknown_ip"))


def by_gap(events: DataFrame, keys: list[str], ts: str, order: list[str], idle: float = IDLE) -> DataFrame:
    """``events`` with ``segment``, counted from 0 within the keys: a gap above ``idle`` seconds starts a new one.

    ``ts`` is in seconds; ``order`` breaks its ties. Events without a time are dropped. One shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    gap = F.col(ts) - F.lag(ts).over(w)
    return events.filter(F.col(ts).isNotNull()).withColumn("__new", F.coalesce((gap > idle).cast("int"), F.lit(0))).withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def by_gap_wide(events: DataFrame, keys: list[str], ts: str, order: list[str], idle: float = IDLE, span: float = 86_400) -> DataFrame:
    """The same as ``by_gap`` where a few keys may have most of the events, such as clients behind one proxy.

    Events are split by key and ``span`` seconds, and counted within these; then only one row per key and span is
    carried over the spans of a key: whether its first event opens a session after the last one before, and how many
    sessions were opened up to there. Ties in time never cross a span.
    """
    cut = events.filter(F.col(ts).isNotNull()).withColumn("__span", F.floor(F.col(ts) / span))
    here = Window.partitionBy(*keys, "__span").orderBy(ts, *order)
    gap = F.col(ts) - F.lag(ts).over(here)
    cut = cut.withColumn("__new", F.coalesce((gap > idle).cast("int"), F.lit(0))).withColumn("__own", F.sum("__new").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    per = cut.groupBy(*keys, "__span").agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"), F.sum("__new").alias("__opened"))
    over = Window.partitionBy(*keys).orderBy("__span")
    per = per.withColumn("__opens", F.coalesce((F.col("__first") - F.lag("__last").over(over) > idle).cast("int"), F.lit(0)))
    # opened in the spans before, and at this span's own beginning
    ahead = F.sum(F.col("__opened") + F.col("__opens")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__opened")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, "__span")]
    carried = per.select(*[F.col(k).alias(f"__{k}") for k in (*keys, "__span")], ahead.alias("__ahead"))
    joined = cut.join(carried, same).withColumn("segment", F.col("__ahead") + F.col("__own"))
    return joined.select(*events.columns, "segment")


def capped(events: DataFrame, keys: list[str], ts: str, order: list[str], idle: float = IDLE, max_seconds: float = MAX_SECONDS, max_events: int = MAX_EVENTS) -> DataFrame:
    """``events`` with ``segment`` and ``part``: a segment is cut before an event more than ``max_seconds`` after
    the part's first or when the part has ``max_events``.

    Cuts depend on those before, but never reach over a gap. Segments within both caps, known from window
    counts, stay in the engine. The others run in order through a fold, batch by batch, which keeps a part's
    first time and count only; they are where the windows left them, so nothing is shuffled again.
    """
    seg = Window.partitionBy(*keys, "segment")
    found = by_gap(events, keys, ts, order, idle).withColumns({"__n": F.count("*").over(seg), "__span": F.max(ts).over(seg) - F.min(ts).over(seg)})
    over = (F.col("__n") > max_events) | (F.col("__span") > max_seconds)
    short = found.filter(~over).withColumn("part", F.lit(0).cast("bigint"))
    long = found.filter(over)
    row = Window.partitionBy(*keys, "segment").orderBy(ts, *order)
    long = long.withColumn("__row", F.row_number().over(row))
    long = long.withColumn("__ts", F.col(ts).cast("double")).sortWithinPartitions(*keys, "segment", "__row")
    schema = long.withColumn("part", F.lit(0).cast("bigint")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, part = 0.0, 0, 0
        for batch in batches:
            parts = []
            for row, t in zip(batch.column("__row").to_pylist(), batch.column("__ts").to_pylist(), strict=True):
                if row == 1:
                    first, n, part = t, 0, 0
                elif t - first > max_seconds or n >= max_events:
                    first, n, part = t, 0, part + 1
                n += 1
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64())], names=[*batch.schema.names, "part"])

    long = long.mapInArrow(fold, schema).drop("__row", "__ts")
    return short.unionByName(long).drop("__n", "__span")


def summaries(events: DataFrame, keys: list[str], parts: list[str], ts: str, order: list[str], abnormal: Column) -> DataFrame:
    """One row per session: start, end, length, label (abnormal if any event is)."""
    return events.groupBy(*keys, *parts).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("session_length"), F.when(F.coalesce(F.bool_or(abnormal), F.lit(False)), "abnormal").otherwise("normal").alias("session_label"))


def steps(events: DataFrame, session: list[str], ts: str, order: list[str]) -> DataFrame:
    """``events`` with ``step`` from 1 within the session."""
    return events.withColumn("step", F.row_number().over(Window.partitionBy(*session).orderBy(ts, *order)))


def chosen(events: DataFrame, site: str = "", most: int = 0, session: str = "session_id") -> DataFrame:
    """``events`` of one site (all if empty) and, with ``most``, of its first sessions by id: a top-k, not a sort."""
    own = events.filter(F.col("site_id") == site) if site else events
    return own.join(F.broadcast(own.select(session).distinct().orderBy(session).limit(most)), session, "left_semi") if most else own


def session_id(site: str, client: str, start: str, ordinal: str) -> Column:
    """Site, client and start second; the ordinal keeps apart parts that start in one second."""
    return F.concat_ws("_", F.lit("sess"), site, client, F.floor(start).cast("string"), F.col(ordinal).cast("string"))


def length_bucket(length: Column) -> Column:
    """Buckets by length; their bounds are read from the names."""
    return F.when(length <= 2, "short_1_2").when(length <= 50, "main_3_50").otherwise("long_51_plus")


def run_report(sessions: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Counters of a run, one row each (counter, n): events, sessions, ``label_..`` and ``length_..``; and rejected lines by ``reason``.

    A counter without anything to count has no row.
    """
    one = sessions.groupBy("session_length", "session_label").agg(F.count("*").alias("n"), F.sum("session_length").alias("events"))
    names = F.array(F.struct(F.lit("events").alias("counter"), F.col("events").alias("n")), *[F.struct(c.alias("counter"), F.col("n").alias("n")) for c in (F.lit("sessions"), F.concat(F.lit("label_"), "session_label"), F.concat(F.lit("length_"), F.col("session_length").cast("string")))])
    rows = one.select(F.explode(names).alias("c")).select("c.counter", "c.n")
    if rejected is not None:
        rows = rows.union(rejected.filter("reason != 'ok'").groupBy("reason").agg(F.count("*").alias("n")))
    return rows.groupBy("counter").agg(F.sum("n").alias("n"))
