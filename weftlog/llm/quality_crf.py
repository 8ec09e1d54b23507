"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's potentials are linear in its own features and those
of the lines before and after it, and neighbouring labels have transition potentials; the marginals come
from the forward-backward recursions. A text's quality is its lines' marginals of being good, averaged by
length, and set on the scale of a probability by a logistic fit.

Labels are of documents, so training begins with each line having its document's label, and then repeats
with the lines of documents labelled bad weighted by their own marginals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import seeded_key, working

#: Labelled documents the model is fitted on, and characters of one of them, at most; chosen by a seeded key.
TRAIN_DOCS, TRAIN_CHARS = 6000, 20_000
ROWS = 128
STEPS, RATE, DECAY = 150, 0.1, 1e-3

UPPER = bytes(range(65, 91))
DIGIT = b"0123456789"
SYMBOL = b"#*$%&|<>"
LOUD = b"!?"
POINT = b".,;:"
OWN = 15


def own_features(line: bytes) -> list[float]:
    n = len(line)
    words = line.split()
    k = len(words)
    if not k:
        return [1.0, 1.0] + [0.0] * (OWN - 2)
    distinct = len(set(words))
    return [
        1.0, 0.0,
        (n - len(line.translate(None, UPPER))) / n,
        (n - len(line.translate(None, DIGIT))) / n,
        min(1.0, (n - len(line.translate(None, SYMBOL))) / k),
        min(1.0, (n - len(line.translate(None, LOUD))) / k),
        min(1.0, (n - len(line.translate(None, POINT))) / k),
        min(1.0, line.count(b"|") / k),
        min(1.0, distinct / k),
        sum(map(eq, words, words[1:])) / k,
        1.0 if k >= 5 and distinct * 2 < k else 0.0,
        math.log1p(k) / 5,
        min(1.0, n / k / 15),
        1.0 if line.rstrip()[-1:] in (b".", b"!", b"?") else 0.0,
        1.0 if k < 5 else 0.0,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with those of its neighbours (zeros beyond the ends), and lengths in bytes plus one."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    own = np.array([own_features(x) for x in lines], np.float32)
    none = np.zeros((1, OWN), np.float32)
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])]), np.array([len(x) + 1 for x in lines], np.float64)


class Chains:
    """Documents' lines side by side, by step: position t of all chains longer than t is one slice."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        self.order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        sizes = np.array([len(docs[i]) for i in self.order])
        self.alive = [int((sizes > t).sum()) for t in range(sizes.max())] if len(sizes) else []
        self.start = np.r_[0, np.cumsum(self.alive)].astype(int)
        place = [np.array([self.start[t] + k for t in range(n)]) for k, n in enumerate(sizes)]
        self.place = [place[self.order.index(i)] for i in range(len(docs))] if len(docs) < 2 else [p for _, p in sorted(zip(self.order, place, strict=True), key=lambda x: x[0])]
        self.x = np.zeros((int(self.start[-1]), docs[0].shape[1] if docs else 0), np.float64)
        for p, d in zip(self.place, docs, strict=True):
            self.x[p] = d

    def marginals(self, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) at every line, and the expected transition counts (2 by 2)."""
        s = self.x @ w
        emit = np.stack([np.zeros_like(s), s], axis=1)
        emit = np.exp(emit - emit.max(axis=1, keepdims=True))
        move = np.exp(trans - trans.max())
        fwd, pairs = np.empty_like(emit), np.zeros((2, 2))
        for t, n in enumerate(self.alive):
            a = emit[self.start[t] : self.start[t] + n] * (fwd[self.start[t - 1] : self.start[t - 1] + n] @ move if t else 0.5)
            fwd[self.start[t] : self.start[t] + n] = a / a.sum(axis=1, keepdims=True)
        bwd = np.ones_like(emit)
        for t in range(len(self.alive) - 1, 0, -1):
            n, here, before = self.alive[t], self.start[t], self.start[t - 1]
            ahead = emit[here : here + n] * bwd[here : here + n]
            both = fwd[before : before + n, :, None] * move[None] * ahead[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = ahead @ move.T
            bwd[before : before + n] = b / b.sum(axis=1, keepdims=True)
        p = fwd * bwd
        return p[:, 1] / p.sum(axis=1), pairs


def fit_crf(chains: Chains, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions whose expectations match those of the (soft) line labels, by Adam.

    ``good`` is each line's probability of being good; transitions expected of the labels take neighbours
    as independent. ``weight`` evens out the two kinds of documents in the line potentials.
    """
    d = chains.x.shape[1]
    theta, m, v = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
    seen = np.zeros((2, 2))
    for t in range(1, len(chains.alive)):
        n = chains.alive[t]
        a, b = good[chains.start[t - 1] : chains.start[t - 1] + n], good[chains.start[t] : chains.start[t] + n]
        seen += [[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]]
    total = max(1.0, weight.sum())
    for step in range(1, STEPS + 1):
        p, pairs = chains.marginals(theta[:d], theta[d:].reshape(2, 2))
        g = np.r_[chains.x.T @ (weight * (p - good)) / total, (pairs - seen).ravel() / max(1.0, seen.sum())] + DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:d], theta[d:].reshape(2, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of P(y = 1) by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def document_quality(chains: Chains, p: np.ndarray, lengths: list[np.ndarray]) -> np.ndarray:
    return np.array([(p[at] * n).sum() / n.sum() for at, n in zip(chains.place, lengths, strict=True)])


def fit(texts: list[str | None], labels: list[int], rounds: int = 2) -> dict:
    """The model for ``texts`` labelled 1 (good) or 0. Without both labels, scores are the labels' mean."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    made = [features(t) for t in texts]
    lengths = [n for _, n in made]
    chains = Chains([x for x, _ in made])
    mean, sd = chains.x.mean(axis=0), chains.x.std(axis=0)
    scale = np.where(sd > 1e-6, sd, 1.0)
    mean[0], scale[0] = 0.0, 1.0
    chains.x = (chains.x - mean) / scale
    label = np.empty(len(chains.x))
    for at, v in zip(chains.place, y, strict=True):
        label[at] = v
    good = label.copy()
    share = {v: max(1.0, (label == v).sum()) for v in (0.0, 1.0)}
    weight = np.where(label == 1, len(label) / 2 / share[1.0], len(label) / 2 / share[0.0])
    for turn in range(rounds):
        w, trans = fit_crf(chains, good, weight)
        p, _ = chains.marginals(w, trans)
        if turn + 1 < rounds:
            good = np.where(label == 1, 1.0, p)
            for at, v in zip(chains.place, y, strict=True):  # a bad document's worst line stays bad
                if v == 0:
                    good[at[np.argmin(p[at])]] = 0.0
    a, b = fit_logistic(logit(document_quality(chains, p, lengths)), y)
    return {"w": w, "trans": trans, "mean": mean, "scale": scale, "a": a, "b": b}


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    made = [features(t) for t in texts]
    chains = Chains([(x - model["mean"]) / model["scale"] for x, _ in made])
    p, _ = chains.marginals(model["w"], model["trans"])
    q = document_quality(chains, p, [n for _, n in made])
    return 1 / (1 + np.exp(-np.clip(model["a"] * logit(q) + model["b"], -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where, most: int, chars: int, id_col: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most ``most`` (text, label) pairs of labelled rows that ``where`` keeps, texts of up to ``chars`` characters.

    Half of them for each label if there are so many, by a seeded key of the id. Ids and lengths are
    chosen first; the texts of the chosen alone come to the driver. Null ids and labels are left out, the
    larger of two labels of an id counts, and of texts with one id the last in code point order.
    """
    marked = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    fit_for = docs.filter(where(id_col) & (F.coalesce(F.length(text), F.lit(0)) <= chars))
    pool = fit_for.select(F.col(id_col).alias("__id"), seeded_key(41, id_col).alias("__k")).join(marked, "__id")
    chosen = [r for y in (0, 1) for r in pool.filter(F.col("__y") == y).orderBy("__k", "__id").limit(most // 2).collect()]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(r["__id"], r["__y"]) for r in chosen], "`__id` bigint, `__y` int").dropDuplicates(["__id"])  # at most `most` rows
    rows = fit_for.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("__t")).join(F.broadcast(ids), "__id").select("__id", "__t", "__y").collect()
    once = {r["__id"]: (r["__t"], r["__y"]) for r in sorted(rows, key=lambda r: (r["__id"], r["__t"] or ""))}
    return [once[k] for k in sorted(once)]


def train(docs: DataFrame, labels: DataFrame, where, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> dict:
    """The model fitted on ``labelled_sample``; without both labels (an empty table, say) scores are the labels' mean, or 0.5."""
    pairs = labelled_sample(docs, labels, "quality", where, most, chars)
    return fit([t for t, _ in pairs], [y for _, y in pairs])


def score(docs: DataFrame, model: dict, out: str = "score", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``out``: 0 to 1, higher for better texts. A null or empty text is one empty line.

    A column ``out`` that the input has is replaced. ``keep`` names the columns that are returned, all by default; others
    are not read, and the text goes to the workers once. An empty table gives no rows.
    """
    docs = docs.drop(out)
    names = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    within = text in names and docs.schema[text].dataType.simpleString() == "string"
    own = docs.select(row) if within else docs.select(row, F.col(text).cast("string").alias("__t"))
    schema = docs.select(row, F.lit(0.0).alias("__score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = some.column(0).flatten()[names.index(text)] if within else some.column(1)
                yield pa.record_batch([some.column(0), pa.array(scores(model, texts.to_pylist()), pa.float64())], names=["__row", "__score"])

    return own.mapInArrow(run, schema).select("__row.*", F.col("__score").alias(out))
