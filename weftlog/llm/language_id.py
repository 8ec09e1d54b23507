"""Language ID by rank-order profiles.

A profile is a language's most frequent letter n-grams (1 to 3 letters, words padded by one space) in order.
A text's own most frequent n-grams, in order, are compared to each profile: the out-of-place distance is the
sum of how far each lies from its place there, a missing one counting as far as the profile is long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.common import few, seeded_key, written

PROFILE = 400
#: Labelled documents per language that a profile is counted from, at most; chosen by a seeded key.
TRAIN_DOCS = 2000
#: So many times the wanted documents are expected among the keys that are ranked.
DRAWN = 4
ROWS = 256
SPACE = 32
BITS = 21

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as integers, and their counts; both empty if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[codes]
    codes = np.concatenate([[SPACE], np.where(letter, codes, SPACE), [SPACE]])
    letter = codes != SPACE
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    one = codes[letter]
    two = (codes[:-1] << BITS | codes[1:])[letter[:-1] | letter[1:]]
    three = (a << 2 * BITS | b << BITS | c)[letter[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def most_frequent(grams: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The first n by falling count, ties by value."""
    if len(grams) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:n]


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", where=None, per_lang: int = TRAIN_DOCS, size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's profile, from at most ``per_lang`` documents with a non-null language that ``where`` keeps.

    Documents are those with the smallest keys of their ids; rows with one id count as one document, and a
    null id, language or text is left out. Keys are drawn and ranked without texts, the first few times
    ``per_lang`` of a language only; the texts are read where they lie, past the language's last key, and
    are not shuffled. A profile of ``size`` n-grams for each language comes back; an empty table gives none.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("id is not null and lang is not null and text is not null")
    own = (own if where is None else own.filter(where("id"))).withColumn("key", seeded_key(31, "id"))
    share = written(own.groupBy("lang").agg((DRAWN * per_lang * float(2**60) / F.count("*")).alias("most")), "languages")
    drawn = own.select("lang", "key").join(few(share), "lang").filter("key <= most").select("lang", "key").distinct()
    first = Window.partitionBy("lang").orderBy("key")
    edge = written(drawn.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_lang).groupBy("lang").agg(F.max("key").alias("edge")), "edges")
    sample = own.join(few(edge), "lang").filter("key <= edge").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some: dict[str, list] = {}
                for name, body in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True):
                    some.setdefault(name, []).append(ngrams(body))
                for name, parts in some.items():
                    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                    yield pa.record_batch([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("r", rank).filter(F.col("r") <= size).select("lang", "r", "gram").collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.r)):
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.names, self.size = sorted(profiles), size
        self.known = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in self.names])) if profiles else np.zeros(0, np.int64)
        self.place = np.full((len(self.names), len(self.known) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.place[i, np.searchsorted(self.known, profiles[name])] = np.arange(len(profiles[name]))

    def closest(self, text: str | None) -> tuple[str, float]:
        """Language and confidence: 1 - nearest / next distance (1 if there is one language only)."""
        if not text or not self.names:
            return "und", 0.0
        grams = most_frequent(*ngrams(text), self.size)
        if not len(grams):
            return "und", 0.0
        at = np.searchsorted(self.known, grams)
        at[self.known[np.minimum(at, len(self.known) - 1)] != grams] = len(self.known)
        place = self.place[:, at]
        away = np.where(place < 0, self.size, np.abs(place - np.arange(len(grams)))).sum(axis=1)
        order = np.lexsort((np.arange(len(away)), away))
        if len(order) == 1:
            return self.names[0], 1.0
        near, then = away[order[0]], away[order[1]]
        return self.names[order[0]], float(1 - near / then) if then else 0.0


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred and score. ``und`` with score 0 for a null text or one without a letter, and without any profile.

    Of languages as near as each other the first by name is taken, with score 0. Rows with the same id or text are judged
    apart; an empty table gives no rows, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        for batch in batches:
            found = [model.closest(t) for at in range(0, batch.num_rows, ROWS) for t in batch.column(1).slice(at, ROWS).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id bigint, lang_pred string, score double")
