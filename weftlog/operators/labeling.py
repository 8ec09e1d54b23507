"""Labels of access records from security records with the same request id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows from start to end, both included; rows without a time are dropped."""
    return df.filter(F.col(ts).between(F.lit(start), F.lit(end)))


def tag_of(line: Column, access: str, security: str) -> Column:
    return F.when(line.contains(access), "access").when(line.contains(security), "security").otherwise("unknown")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each non-null, non-empty key. Spark keeps one row per key and task before it shuffles."""
    keyed = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return keyed.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def label(access: DataFrame, security: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """All access rows with ``label`` (1 if matched, even without a kind), ``security_event_type`` and ``matched_id``."""
    first = first_per_key(security, key, order).select(F.col(key).alias("matched_id"), F.col(kind).alias("security_event_type"))
    joined = access.join(first, F.col(key) == F.col("matched_id"), "left")
    return joined.withColumns({"label": F.col("matched_id").isNotNull().cast("int"), "security_event_type": F.coalesce("security_event_type", F.lit("none"))})


def matched(security: DataFrame, access: DataFrame, key: str) -> DataFrame:
    return security.join(access.select(key), key, "left_semi")


def unmatched(security: DataFrame, access: DataFrame, key: str) -> DataFrame:
    return security.join(access.select(key), key, "left_anti")


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count("*").alias("n_access"), F.count_if(F.col("label") == 1).alias("n_labelled"), F.count_if((F.col("label") == 1) & (F.col("security_event_type") == "none")).alias("n_without_kind"))
