"""Substring dedup by hashing lines, paragraphs or clauses.

Texts are cut into units: paragraphs, lines, or clauses (a clause ends at the end of a line and where one of
``.!?,;:`` stands before white space). A unit is normalised (A-Z lower-cased, runs of ASCII white space one
space, trimmed) and hashed; digests are grouped over all documents, the earliest occurrence by (document id,
offset) stays, and each later one is removed, named by its offsets in the original text.

Short units repeat without being copied, so with ``min_words`` a unit that has fewer words is hashed together
with as many of those that follow as it takes. The end of such a passage depends on its own words only, so
equal passages are cut alike wherever they stand. Passages may overlap; a unit that goes as part of one
always has an equal unit at an earlier place that stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.common import join_hot, written

#: White space between two units; units and white space make up the whole text.
SEPARATOR = {
    "paragraph": re.compile(r"[\x20\x09-\x0D]*\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*"),
    "line": re.compile(r"[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*"),
    "clause": re.compile(r"(?<=[.!?,;:])[\x20\x09-\x0D]+|[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*"),
}
SPACES = " \t\n\x0b\x0c\r"
ROWS = 64
UNIT_DDL = "doc bigint, start bigint, `end` bigint, digest binary"


def spans(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """Start and end of each unit that has a word, in characters of the text as it is."""
    at, end = len(text) - len(text.lstrip(SPACES)), len(text.rstrip(SPACES))
    for m in SEPARATOR[unit].finditer(text, at, end):
        yield at, m.start()
        at = m.end()
    if at < end:
        yield at, end


def passages(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and digest of the passage from each unit on, of at least ``min_words`` words; none where the text ends before."""
    places = list(spans(text, unit))
    words = [text[a:b].encode("utf-8", "surrogatepass").lower().split() for a, b in places]
    held, last = 0, 0
    for i, (start, _) in enumerate(places):
        while last < len(places) and (held < min_words or last == i):
            held += len(words[last])
            last += 1
        if held < min_words:
            return
        yield start, places[last - 1][1], md5(b" ".join(w for some in words[i:last] for w in some)).digest()
        held -= len(words[i])


def units(docs: DataFrame, unit: str, min_words: int, id_col: str, text: str) -> DataFrame:
    """doc, start, end and digest of every passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = [(doc, *p) for doc, body in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True) for p in passages(body or "", unit, min_words)]
                cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc", "start", "end", "digest"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(cut, UNIT_DDL)


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per removed unit or passage: doc, start, end, digest, keep_doc, keep_start, n (occurrences).

    Ids order documents, a null id first; rows with the same id are one document, whose equal offsets are
    one occurrence. A null text has no unit. Nothing repeated, or an empty table, gives no rows.
    """
    found = written(units(docs, unit, min_words, id_col, text), "units")
    # one occurrence first, then groups; both combine before they shuffle
    first = found.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last"), F.count("*").alias("n"))
    first = first.filter(F.col("first") != F.col("last")).select("digest", F.col("first.doc").alias("keep_doc"), F.col("first.start").alias("keep_start"), "n")
    first = written(first, "firsts")
    joined = join_hot(found, first, "digest", "n", found.count(), F.xxhash64("doc", "start"), "inner")
    return joined.filter(~(F.col("doc").eqNullSafe(F.col("keep_doc")) & (F.col("start") == F.col("keep_start")))).select("doc", "start", "end", "digest", "keep_doc", "keep_start", "n")


def without_repeats(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed spans cut out of the text, and ``removed`` (their original start and end, overlapping ones as one).

    A text of which only white space is left is empty; a null text stays null.
    """
    last = F.max("end").over(Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum("new").over(Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    merged = removed.select("doc", "start", "end").withColumn("new", F.coalesce((F.col("start") > last).cast("int"), F.lit(1))).withColumn("group", group).groupBy("doc", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed")).withColumnRenamed("doc", "__doc")
    joined = docs.drop("removed").join(cuts, F.col(id_col).cast("bigint").eqNullSafe(F.col("__doc")), "left").drop("__doc")
    body = F.col(text)
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("removed", lambda x: x["end"]))
    ends = F.concat(F.transform("removed", lambda x: x["start"]), F.array(F.length(body).cast("bigint")))
    rest = F.array_join(F.zip_with(edges, ends, lambda a, b: F.substring(body, (a + 1).cast("int"), (b - a).cast("int"))), "")
    cleaned = F.when(F.col("removed").isNull(), body).otherwise(F.when(F.trim(F.translate(rest, "\n\r\t", "   ")) == "", "").otherwise(rest))
    return joined.withColumn(text, cleaned).withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")))
