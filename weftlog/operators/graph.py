"""Connected components of an edge table, by minima of neighbours with shortcuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weftlog-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftlog-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for ``nodes`` (node) and ``edges`` (a, b).

    Each round takes the smallest root among neighbours and then the root's root; rounds grow with the
    logarithm of the longest chain. Minima combine before the shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = written(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = state.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = written(step.join(up, "root").select("node", "old", F.least("root", "up").alias("root")))
        state = new.select("node", "root")
        if new.filter("root != old").isEmpty():
            return state
