"""What the corpus operators share: written tables, prefix sums and joins that stand hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.operators.graph import written

__all__ = ["FEW", "WORD", "few", "held_out", "join_hot", "keeps", "prefix_sums", "seeded_key", "text_or_empty", "working", "written"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A key counts as hot above this share of all rows, so there are never more than 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: Rows that a key may have at least before it is hot.
HOT_LEAST = 1000
#: Rows up to which a counted table is broadcast.
FEW = 50_000


#: How an operator's workers forget what they remember, by operator.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """Say how a worker frees what it remembers for an operator."""
    _KEPT[operator] = forget


def working(operator: str) -> None:
    """Free what this worker remembers for other operators: workers outlive a job, and the next one needs their memory."""
    for name, forget in _KEPT.items():
        if name != operator:
            forget()


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def seeded_key(seed: int, *cols: str) -> Column:
    """A uniform integer of 60 bits that depends on the seed and the columns only."""
    parts = [F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id never is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def join_hot(rows: DataFrame, side: DataFrame, key: str, n_col: str, total: int, salt: Column, how: str = "left") -> DataFrame:
    """Join rows with a table of one row per key whose ``n_col`` says how many rows have that key.

    Keys with over ``HOT_SHARE`` of ``total`` rows, at most 1 / HOT_SHARE of them, are dealt by ``salt``
    into parts of at most that share; that bounded list of keys is what gets broadcast.
    """
    limit = max(HOT_LEAST, int(total * HOT_SHARE))
    parts = F.ceil(F.col(n_col) / limit).cast("int")
    hot = side.filter(F.col(n_col) > limit).select(key, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.coalesce(F.pmod(salt, F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    copies = side.withColumn("__salt", F.explode(F.when(F.col(n_col) > limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def few(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if its counted rows are few; beyond, Spark joins it as it sees fit."""
    return F.broadcast(table) if table.count() <= FEW else table


def prefix_sums(counts: DataFrame, bucket: str, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Exclusive running sums over all buckets (of each ``by``), in two levels so that no task gets them all."""
    by = by or []
    level = counts.withColumn("__high", F.shiftright(F.col(bucket), 10))
    high = level.groupBy(*by, "__high").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__high").rowsBetween(Window.unboundedPreceding, -1)
    high = high.select(*by, "__high", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__high").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return level.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(high, [*by, "__high"]).withColumn(out, F.col("__before") + F.col("__in")).drop("__high", "__in", "__before")
