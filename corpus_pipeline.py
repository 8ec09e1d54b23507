"""From documents to packed sequences: quality, exact copies, near copies, source mix, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. A null text counts as empty in every
stage. Rows with the same id are judged each by its own text; of rows alike in both, the stages of copies keep one. An
empty table gives an empty table, and columns that a stage does not name pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm import exact_dedup, mixing, packing, quality_crf, simhash
from weftlog.llm.common import written
from weftlog.llm.queries import QUALITY_THRESHOLD, not_in_fold, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), not_in_fold(5, 0))
    return quality_crf.score(docs, model, out="__quality").filter(F.col("__quality") >= QUALITY_THRESHOLD).drop("__quality")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.keep_one(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more by five-word shingles) the row with the smallest doc_id."""
    return simhash.keep_dissimilar(docs, similarity=0.8, size=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.taken_rows(mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of several lengths."""
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("doc", "doc_id")


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources to target weights", source_mix), ("packing", pack)]

#: A random field, SimHash and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
