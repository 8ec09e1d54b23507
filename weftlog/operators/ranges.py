"""Running totals over a whole table, in two levels: within ranges of the order, and over the ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.operators.graph import written


def before(df: DataFrame, order: list[Column], out: str, value: str | None = None) -> DataFrame:
    """``df`` with ``out``: the rows (or the sum of ``value``) before each row in ``order``, which should be total.

    Ranges are shuffled apart, so no task gets all rows; only one row a range is summed in a window of its own. The
    table is written once, so that a lost executor does not lay the ranges anew.
    """
    laid = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    amount = F.col(value) if value else F.lit(1)
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = laid.groupBy("__range").agg(F.sum(amount).alias("__sum")).withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).select("__range", "__ahead")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("__within", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(F.broadcast(totals), "__range")
    return placed.withColumn(out, F.col("__ahead") + F.col("__within")).drop("__range", "__ahead", "__within")
