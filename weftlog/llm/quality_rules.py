"""Quality rules: figures of each text, and lines that too many documents of a host share.

Normalised lines are hashed and the documents that hold a line are counted per host, each once, copies of
a text included. A line above its limit is boilerplate and goes; a document of which too little is left is rejected.
Everything is built-in functions: one pass over the texts writes figures and line hashes, and what follows
has hashes only. A line's or a text's copies are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import join_hot, seeded_key, text_or_empty, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
#: A line is boilerplate in over so many documents of its host and over this share of them.
LINE_DOCS, LINE_SHARE = 20, 0.02
#: A document is depleted when less than this share of its lines' bytes is left.
MIN_LEFT = 0.3


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur at least twice in the array, the first included."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = with_array(ordered, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (same(s, i, i - 1) | same(s, i, i + 1)).alias("t"))), lambda x: x["t"]), lambda x: x["i"])))
        return with_array(twice, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    found = with_array(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("bigint"))


def with_array(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def figures(docs: DataFrame, id_col: str, host: str, text: str) -> DataFrame:
    """id, host, text_hash, the base figures, and ``lines``: hash and bytes of each normalised line."""
    body = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("none")).alias("host"), text_or_empty(text).alias("body"))
    body = body.select("*", F.array_remove(F.split("body", SPACE), "").alias("words"), F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("raw"), normal_lines(F.col("body")).alias("normal"))
    return body.select(
        "id", "host", F.xxhash64("body").alias("text_hash"), F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), (F.size("raw") - F.size(F.array_distinct("raw"))).cast("bigint").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("normal", lambda x: F.struct(F.xxhash64(x).alias("h"), F.octet_length(x).alias("n"))).alias("lines"),
    )


def normal_lines(body: Column) -> Column:
    """Lines in lower case, trimmed, white space runs one space; lines without a word left out."""
    lines = F.split(F.regexp_replace(F.lower(body), r"[\x20\x09\x0B-\x0D]+", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def frequent_lines(table: DataFrame, line_docs: int, line_share: float) -> tuple[DataFrame, DataFrame]:
    """All (host, h, text_hash, n) of distinct texts and the lines above their limit, as (key, texts that have it)."""
    texts = table.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"), F.count("*").alias("copies"))
    lines = texts.select("host", "text_hash", "copies", F.explode("lines").alias("l")).groupBy("host", "text_hash", F.col("l.h").alias("h")).agg(F.sum("l.n").alias("n"), F.first("copies").alias("copies"))
    lines = written(lines.select("text_hash", "host", F.xxhash64("host", "h").alias("key"), "h", "n", "copies"), "lines")
    counts = written(lines.groupBy("host", "key").agg(F.sum("copies").alias("docs"), F.count("*").alias("texts")).filter(F.col("docs") > line_docs), "counts")
    hosts = table.groupBy("host").agg(F.count("*").alias("host_docs")).join(counts.groupBy("host").agg(F.count("*").alias("m")), "host")
    frequent = join_hot(counts, hosts, "host", "m", counts.count(), F.col("key"), "inner").filter(F.col("docs") > line_share * F.col("host_docs"))
    return lines, written(frequent.select("key", "texts"), "frequent")


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, min_left: float = MIN_LEFT, id_col: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per input row: id, the figures, base_failed, left_share, depleted and kept.

    A null text has no words and fails; null hosts are one host. Rows with equal text and host share a
    verdict, and each counts for their lines. An empty table gives no rows.
    """
    table = written(figures(docs, id_col, host, text), "figures")
    lines, frequent = frequent_lines(table, line_docs, line_share)
    flagged = join_hot(lines, frequent, "key", "texts", lines.count(), F.col("text_hash"))
    left = flagged.groupBy("host", "text_hash").agg((F.sum(F.when(F.col("texts").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("left_share"), F.first("copies").alias("copies"))
    left = left.filter(F.col("left_share") < 1).select(F.xxhash64("host", "text_hash").alias("text_key"), "left_share", "copies")
    rows = join_hot(table.withColumn("text_key", F.xxhash64("host", "text_hash")).drop("lines"), left, "text_key", "copies", table.count(), F.xxhash64("id"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("left_share", F.coalesce("left_share", F.lit(1.0))).withColumns({"base_failed": failed, "depleted": F.col("left_share") < min_left})
    return rows.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_share", "depleted", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))


def without_frequent_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, id_col: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with the lines above their limit cut from the text; nulls, ties and empty tables as in ``judge``."""
    table = written(figures(docs, id_col, host, text), "figures")
    lines, frequent = frequent_lines(table, line_docs, line_share)
    found = join_hot(lines, frequent, "key", "texts", lines.count(), F.col("text_hash"), "inner").groupBy("host", "text_hash").agg(F.collect_set("h").alias("__gone"), F.first("copies").alias("__copies"))
    gone = found.select(F.xxhash64("host", "text_hash").alias("__text"), "__gone", "__copies")
    h = F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("none"))
    tagged = docs.withColumn("__text", F.xxhash64(h, F.xxhash64(text_or_empty(text))))
    joined = join_hot(tagged, gone, "__text", "__copies", docs.count(), seeded_key(7, id_col))
    line = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09\x0B-\x0D]+", " "))
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("__gone", F.xxhash64(line(x))))
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).select(*[f"`{c}`" for c in docs.columns])
