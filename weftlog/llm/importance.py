"""Importance resampling towards a target, over hashed n-grams found with suffix arrays.

A task turns a block of texts into word ids and sorts all positions by the words from there on, as deep as the
longest n-gram. Where the common prefix with the position before is shorter than n, a new n-gram begins, so
each run of the order is one n-gram with all its occurrences: it is hashed once, from the CRCs of its words,
and the bucket is scattered back to the occurrences. Bucket counts of corpus and target, one number a bucket
and task, give each bucket's gain; a second pass over the texts adds up the gains of each document.

The highest scores are found by counts of scores, so that no task sees them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.common import prefix_sums, written
from weftlog.llm.flat import blocks, sums
from weftlog.llm.pieces import texts_of

BUCKETS = 10_000
#: Words of the longest n-gram.
LONGEST = 3
SEED = 42
MIN_WORDS = 20
PERCENT = 5
#: Positions that are sorted at a time.
SORTED = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Shifts:
    """CRC-32 of joined strings: crc(a + b) is crc(a), moved over the bytes of b, xor crc(b). Moves are linear."""

    def __init__(self) -> None:
        step = np.array([self.byte_table(i) for i in range(256)], np.uint32)
        one = np.zeros((4, 256), np.uint32)
        every = np.arange(256, dtype=np.uint32)
        for place in range(4):
            value = every << np.uint32(8 * place)
            one[place] = (value >> np.uint32(8)) ^ step[value & np.uint32(255)]
        self.powers = [one]  # over 1, 2, 4, ... bytes

    @staticmethod
    def byte_table(i: int) -> int:
        for _ in range(8):
            i = i >> 1 ^ 0xEDB88320 if i & 1 else i >> 1
        return i

    @staticmethod
    def apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & np.uint32(255)] ^ table[1][crc >> np.uint32(8) & np.uint32(255)] ^ table[2][crc >> np.uint32(16) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]

    def over(self, crc: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Each CRC moved over as many bytes as ``lens`` says."""
        crc, power = crc.copy(), 0
        while (lens >> power).any():
            if power == len(self.powers):
                half = self.powers[-1]
                self.powers.append(np.array([self.apply(half, row) for row in half]))
            odd = np.flatnonzero(lens >> power & 1)
            crc[odd] = self.apply(self.powers[power], crc[odd])
            power += 1
        return crc


class Grams:
    """Buckets of all n-grams of a block."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS) -> None:
        self.longest, self.buckets, self.shifts = longest, buckets, Shifts()

    def words(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Word ids of all texts in a row, from 1 on, how many each text has, and the words."""
        body = LOWER[data]
        inside = IN_WORD[body]
        before = np.zeros(len(body), bool)
        before[1:] = inside[:-1]
        starts = np.cumsum(lens) - lens
        before[starts[lens > 0]] = False  # no word spans texts
        at = np.flatnonzero(inside & ~before)
        counts = np.diff(np.searchsorted(at, np.append(starts, len(body))))
        if not len(at):
            return np.zeros(0, np.int64), counts, []
        offsets = np.append(np.concatenate([[0], np.cumsum(inside)])[at], np.count_nonzero(inside)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body[inside])]).dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64) + 1, counts, coded.dictionary.to_pylist()

    def of(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams by length and first word, -1 where a text ends before, and each text's number of words."""
        ids, counts, words = self.words(data, lens)
        size = np.array([0, *map(len, words)], np.int64) + 1  # with the space before
        alone = np.array([0, *map(zlib.crc32, words)], np.uint32)
        spaced = np.array([0, *[zlib.crc32(b" " + w) for w in words]], np.uint32)
        # a zero after each text, and after the last as many as a longest n-gram reaches
        ends = np.cumsum(counts)
        row = np.zeros(len(ids) + len(counts) + self.longest, np.int64)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)
        row[place] = ids
        found = np.full((self.longest, len(ids)), -1, np.int64)
        for begin in range(0, len(ids), SORTED):
            here = place[begin : begin + SORTED]
            self.scatter(row, here, len(words) + 1, alone, spaced, size, found[:, begin : begin + len(here)])
        assert len(ids) == (ends[-1] if len(ends) else 0)
        return found, counts

    def scatter(self, row, here, n_words, alone, spaced, size, out) -> None:
        """The suffix array of the positions ``here`` of ``row``, its runs, and their buckets at the occurrences."""
        deep = np.array([row[here + i] for i in range(self.longest)])
        for i in range(1, self.longest):
            deep[i] *= deep[i - 1] > 0  # nothing counts behind a text's end
        if n_words ** self.longest < 1 << 62:
            key = deep[0]
            for level in deep[1:]:
                key = key * n_words + level
            order = np.argsort(key)
        else:
            order = np.lexsort(deep[::-1])
        deep = deep[:, order]
        new, crc = np.zeros(len(order), bool), None
        new[:1] = True
        for n in range(self.longest):
            new[1:] |= deep[n, 1:] != deep[n, :-1]  # the common prefix with the one before is n words or fewer
            first = np.flatnonzero(new)
            last = deep[n, first]
            if n == 0:
                crc = alone[last]
            else:  # longer n-grams of a run share its shorter one
                crc = self.shifts.over(crc[np.searchsorted(shorter, first, side="right") - 1], size[last]) ^ spaced[last]
            shorter = first
            bucket = np.where(last > 0, (crc % np.uint32(self.buckets)).astype(np.int64), -1)
            out[n, order] = np.repeat(bucket, np.diff(first, append=len(order)))


_LOADED: dict[tuple[int, int], Grams] = {}


def loaded(longest: int, buckets: int) -> Grams:
    return _LOADED.setdefault((longest, buckets), Grams(longest, buckets)) if (longest, buckets) not in _LOADED else _LOADED[longest, buckets]


def bucket_counts(texts: DataFrame, name: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """How often each bucket's n-grams occur in all texts: bucket and ``name``. ``texts`` has an id and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = loaded(longest, buckets), np.zeros(buckets, np.int64)
        for _, data, lens in blocks(batches):
            found, _ = grams.of(data, lens)
            total += np.bincount(found[found >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", name])

    return texts.mapInArrow(run, f"bucket int, {name} bigint").groupBy("bucket").agg(F.sum(name).alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket: floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))). One row a bucket comes to the driver."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus, "bucket", "left").join(target, "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    rows = both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row joins
    return [r["gain"] for r in rows.orderBy("bucket").collect()]


def weights(texts: DataFrame, gain: list[int], longest: int = LONGEST) -> DataFrame:
    """One row per text: id, n_words, n_features, weight."""
    table = np.array([*gain, 0], np.int64)  # of bucket -1 last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = loaded(longest, len(table) - 1)
        for id_, data, lens in blocks(batches):
            found, counts = grams.of(data, lens)
            features, weight = (sums(x.sum(axis=0), counts) for x in (found >= 0, table[found]))
            yield pa.RecordBatch.from_arrays([id_, *map(pa.array, (counts, features, weight))], names=["id", "n_words", "n_features", "weight"])

    return texts.mapInArrow(run, "id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(id_: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) for a uniform u of seed and id alone; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, score: str, id_col: str, of: Column, percent: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... of the highest ``percent`` hundredths of the rows ``of``, ties to the smaller id; null for others.

    Counts of scores tell the least score that is drawn; only rows from there on are ordered, each score by itself.
    """
    of = F.coalesce(of, F.lit(False))
    draw = rows.filter(of).count() * percent // 100
    none = F.lit(None).cast("bigint").alias("rank")
    down = rows.filter(of).groupBy((-F.col(score)).alias("__down")).agg(F.count("*").alias("__n"))
    before = written(prefix_sums(down, "__down", "__n", "__above").filter(F.col("__above") < draw).select("__down", "__above"), "drawn")
    least = before.agg(F.max("__down").alias("m")).first()["m"]
    if least is None:
        return rows.select("*", none)
    drawn = of & (F.col(score) >= -least)
    place = F.row_number().over(Window.partitionBy("__down").orderBy(F.col(id_col).asc_nulls_first())) + F.col("__above")
    top = rows.filter(drawn).withColumn("__down", -F.col(score)).join(before, "__down").withColumn("__place", place)
    top = top.select(*rows.columns, F.when(F.col("__place") <= draw, F.col("__place")).cast("bigint").alias("rank"))
    return rows.filter(~drawn).select("*", none).unionByName(top)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank.

    Words are runs of ASCII letters and digits, A-Z lowered, and of all other characters; features are runs of up to
    ``longest`` words. ``rank`` is null for what is not drawn: of the documents with ``min_words`` words, ``percent``
    hundredths are. A null or empty text has no features and weight 0; a null id draws its noise as an empty one and
    goes first in ties. Rows with the same id and text tie, and take ranks one after the other. An empty corpus gives
    no rows; with an empty target all gains follow from the corpus alone. Other columns are not read.
    """
    texts = texts_of(docs, id_col, text)
    aims = target.select(F.lit(0).cast("bigint").alias("id"), F.col(target_text).cast("string").alias("text"))
    gain = gains(bucket_counts(texts, "s", longest, buckets), bucket_counts(aims, "t", longest, buckets), buckets)
    rows = weights(texts, gain, longest).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return ranked(written(rows, "weights"), "score", "id", F.col("n_words") >= min_words, percent)
