"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what sets toxic text apart. A
window of words is compressed with the ordinary dictionary alone and with the toxic one in front of it; the
bytes that the toxic one saves are the window's distance. A text's windows are summed up (mean, largest,
mean above a byte), and a logistic fit on labelled texts calibrates these into a score.

Most of a toxic text is ordinary, and a dictionary trained on all of it holds ordinary text mainly: alone it
finds next to nothing (README). So there is an extra step, which is not part of the method as named: the
toxic dictionary is trained on words of toxic texts with over-represented letter 5-grams, and it stands in
front of the ordinary one, not alone. The words are chosen greedily: the words of the
most telling 5-gram are set aside before the next is looked for, so that parts of a chosen word do not
bring in ordinary words. Near copies among the labelled texts count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.quality_crf import labelled_sample

#: Labelled documents the model is fitted on, and characters of one of them, at most; chosen by a seeded key.
TRAIN_DOCS, TRAIN_CHARS = 6000, 20_000
WINDOW = 8
LEVEL, MIN_MATCH = 12, 4
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 4_096
GRAM, MIN_Z, MIN_LOG_RATIO = 5, 4.5, 1.5
#: Windows of the labelled ordinary texts that the ordinary dictionary is trained on, evenly spread, about as many at most.
ORDINARY_WINDOWS = 40_000
#: A telling word in over this share of toxic texts is in the dictionary as a whole; training may cut words up.
COMMON = 0.03
ROWS = 64

LETTERS = re.compile(r"[^\W\d_]+")


def bare_words(text: str) -> list[str]:
    return [f" {w} " for w in LETTERS.findall(text.lower())]


def grams(word: str) -> set[str]:
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def unlike(pairs: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Pairs whose text shares at most a fifth of its five-word shingles with those before."""
    seen, out = set(), []
    for text, y in pairs:
        words = text.split()
        shingles = {hash(tuple(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
        if 5 * len(shingles & seen) <= len(shingles):
            seen |= shingles
            out.append((text, y))
    return out


def telling_words(pairs: list[tuple[str, int]]) -> set[str]:
    """Words of toxic texts with a 5-gram that is far more frequent there, chosen greedily."""
    found = [Counter(), Counter()]
    texts = [0, 0]
    for text, y in pairs:
        found[y].update(set(bare_words(text)))
        texts[y] += 1
    holders: dict[str, list[str]] = defaultdict(list)
    count = {0: Counter(), 1: Counter()}
    for word in found[0].keys() | found[1].keys():
        for g in grams(word):
            holders[g].append(word)
            for y in (0, 1):
                count[y][g] += found[y][word]

    def z(g: str) -> float:
        a, b = count[1][g] + 0.5, count[0][g] + 0.5
        ratio = math.log(a / (texts[1] + 1)) - math.log(b / (texts[0] + 1))
        return ratio / math.sqrt(1 / a + 1 / b) if ratio >= MIN_LOG_RATIO else 0.0

    open_grams = {g: v for g in holders if (v := z(g)) >= MIN_Z}
    chosen: set[str] = set()
    while open_grams:
        best = max(open_grams, key=lambda g: (open_grams[g], g))
        gone = [w for w in holders[best] if w not in chosen]
        chosen.update(gone)
        touched = {best}
        for word in gone:
            for g in grams(word):
                for y in (0, 1):
                    count[y][g] -= found[y][word]
                touched.add(g)
        for g in touched & open_grams.keys():
            if (v := z(g)) >= MIN_Z:
                open_grams[g] = v
            else:
                del open_grams[g]
    return chosen


def trained(samples: list[bytes], size: int, k: int) -> bytes:
    """A dictionary's bytes; too few samples to train on are the dictionary themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def common_words(texts: list[list[str]]) -> bytes:
    """Words of over ``COMMON`` of the texts, whole, the most frequent last, where they are cheapest to refer to."""
    n = Counter(w for words in texts for w in set(words))
    return "".join(w for w in sorted(n, key=lambda w: (n[w], w)) if n[w] > COMMON * len(texts)).encode()


def compressor(raw: bytes):
    import zstandard

    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=8 * WINDOW, dict_size=len(raw), min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
    if raw:
        held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=held)


def distances(plain, toxic, text: str | None) -> np.ndarray:
    """Features of a text: mean, logarithm of the largest, and mean above one byte of its windows' distances."""
    saved = np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text)] or [0], np.float64)
    return np.array([saved.mean(), math.log1p(max(0.0, saved.max())), np.maximum(saved - 1, 0).mean(), math.log1p(len(saved))])


def fit(pairs: list[tuple[str | None, int]]) -> dict:
    """The model for (text, label) pairs. Without both labels, scores are the labels' mean, or 0.5; a null text is empty."""
    pairs = unlike([(t or "", y) for t, y in pairs])
    y = np.array([y for _, y in pairs], np.float64)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    words = telling_words(pairs)
    ordinary = [w for i, (t, label) in enumerate(pairs) if label == 0 for w in windows(t)]
    plain = trained(ordinary[:: max(1, len(ordinary) // ORDINARY_WINDOWS)], ORDINARY_BYTES, 200)
    held = [[w for w in bare_words(t) if w in words] for t, label in pairs if label == 1]
    toxic = trained([w.encode() for some in held for w in some] or [b" "], TOXIC_BYTES, 12) + common_words(held)
    a, b = compressor(plain), compressor(toxic + plain)
    x = np.array([distances(a, b, t) for t, _ in pairs])
    mean, sd = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    return {"plain": plain, "toxic": toxic, "mean": mean, "sd": sd, "w": fit_scores((x - mean) / sd, y)}


def fit_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def scorer(model: dict):
    if "constant" in model:
        return lambda text: model["constant"]
    a, b = compressor(model["plain"]), compressor(model["toxic"] + model["plain"])

    def score(text: str | None) -> float:
        v = (distances(a, b, text) - model["mean"]) / model["sd"]
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(v @ model["w"][:-1] + model["w"][-1]))))))

    return score


def train(docs: DataFrame, labels: DataFrame, where, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> dict:
    """The model of ``quality_crf.labelled_sample``, which says what becomes of nulls, ties and repeats."""
    return fit(labelled_sample(docs, labels, "toxic", where, most, chars))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id and score, 0 to 1. A null or wordless text has no window and distance 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in batches:
            found = [of(t) for at in range(0, batch.num_rows, ROWS) for t in batch.column(1).slice(at, ROWS).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id bigint, score double")
