"""Proportional stratified interleaving: every shard gets every source's share of rows.

Rows are shuffled by a seeded key within each source, and the row at rank r of a source of n rows gets
the fractional rank (r + u) / n, u being an offset in (0, 1) of the source's own, so that sources of one
row do not meet at one spot. The order by fractional rank, cut into equal parts, gives the shards: counts
are at most one apart, and each source's rows are spread evenly.

Ranks need no global sort and no task with a whole source. Rows are dealt by (source, leading bits of the
key) and later by leading bits of the fractional rank; either is uniform by construction, so a part holds
about ``ROWS_PER_BUCKET`` rows whatever the sources are. Running sums over counted parts give the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.common import join_hot, prefix_sums, seeded_key, written

ROWS_PER_BUCKET = 1024
KEY_BITS = 60


def interleave(docs: DataFrame, shards: int, strata: str = "source", id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0).

    A null source is a source of its own. Null ids get one common key. Rows with the same id are ordered by
    a hash of their columns; rows alike in every column are interchangeable. Columns ``shard`` and ``slot``
    that the input has are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot")
    own = docs.columns
    total = docs.count()
    bits = max(0, min(30, math.ceil(math.log2(max(1, total / ROWS_PER_BUCKET)))))
    tagged = docs.withColumns({
        "__s": F.when(F.col(strata).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(strata).cast("string"))),
        "__k": seeded_key(seed, id_col),
    }).withColumn("__b", F.shiftright("__k", KEY_BITS - bits))

    filled = tagged.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    sources = filled.groupBy("__s").agg(F.sum("__n").alias("__all"), F.count("*").alias("__m"))
    parts = prefix_sums(filled, "__b", "__n", "__at", ["__s"]).select("__s", "__b", F.col("__at").alias("__before"))
    parts = written(join_hot(parts, sources, "__s", "__m", total // ROWS_PER_BUCKET, F.xxhash64("__b"), "inner").select("__s", "__b", "__all", "__before"), "buckets")

    def ranked(rows: DataFrame, tie) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__k", F.col(id_col).asc_nulls_first(), *tie)) - 1
        offset = (F.conv(F.substring(F.md5("__s"), 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)
        part = (F.col("__before") + F.col("__r") + F.col("__u")) / F.col("__all")
        rows = rows.withColumns({"__r": rank, "__u": offset}).join(parts, ["__s", "__b"]).withColumn("__f", part)
        return rows.withColumn("__fb", F.least(F.floor(F.col("__f") * float(2**bits)), F.lit(2**bits - 1)).cast("long"))

    # The counting pass has the thin columns only; ranks of tied rows are the same set in any order.
    cuts = prefix_sums(ranked(tagged.select(id_col, "__s", "__k", "__b"), []).groupBy("__fb").agg(F.count("*").alias("__m")), "__fb", "__m", "__start")
    tie = [F.xxhash64(*[F.col(f"`{c}`") for c in own])]
    rows = ranked(tagged, tie)
    place = F.row_number().over(Window.partitionBy("__fb").orderBy("__f", "__s", "__k", F.col(id_col).asc_nulls_first(), *tie)) - 1
    n = F.lit(total).cast("long")
    rows = rows.withColumn("__p", place).join(cuts, "__fb").withColumn("__pos", F.col("__start") + F.col("__p"))
    rows = rows.withColumn("shard", F.expr(f"cast(__pos * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("slot", (F.col("__pos") - first).cast("long")).select(*[f"`{c}`" for c in own], "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file; a shard is one task's write."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
