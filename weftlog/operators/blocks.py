"""Cosine distances of all pairs of sequences, block against block: a pair is a row only where it is a result.

Sequences are dealt to blocks, and every two blocks meet in one group of a shuffle. Its task multiplies slices of the
two and keeps what is asked for: sums, minima, nearest ones or trees of links, which are at most a few rows for each
sequence and block. What is shuffled is each sequence once a block, of which there are at most ``BLOCKS`` until
a block has ``ENTRIES`` entries, so it grows with the sequences, and only the multiplications with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.operators.graph import written

LEAST, BLOCKS, ROWS, ENTRIES = 4, 64, 2048, 4_000_000
#: Distances that a task holds at once, and rows of a batch that it returns.
CELLS, BATCH = 1 << 21, 1 << 16
#: Tasks for the pairs of blocks.
TASKS = 400
#: The feature of the length, which all have.
LENGTH = -1


def packed(distinct: DataFrame, vector: DataFrame, norm: DataFrame, *columns: str) -> DataFrame:
    """One row a sequence: at (a number), ``columns`` of ``distinct``, ids and units (its features, of length 1)."""
    names = written(vector.select("feature").distinct().withColumn("id", F.monotonically_increasing_id()))
    lists = vector.join(names, "feature").groupBy("seq").agg(F.collect_list(F.struct("id", "v")).alias("f"))
    rows = distinct.select("seq", *columns).join(norm, "seq").join(lists, "seq", "left")
    entries = F.concat(F.array(F.struct(F.lit(LENGTH).cast("bigint").alias("id"), F.col("len").alias("v"))), F.coalesce("f", F.array().cast("array<struct<id:bigint,v:double>>")))
    rows = rows.select("seq", *columns, F.transform(entries, lambda e: e["id"]).alias("ids"), F.transform(entries, lambda e: e["v"] / F.col("norm")).alias("units"))
    return written(rows.withColumn("at", F.monotonically_increasing_id()))


class Block:
    """Columns of some sequences, and the entries of their vectors by row."""

    def __init__(self, table: pa.Table):
        self.table, self.size = table, table.num_rows
        ids, units = table.column("ids").combine_chunks(), table.column("units").combine_chunks()
        self.row = np.repeat(np.arange(self.size), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
        self.id, self.unit = ids.flatten().to_numpy(zero_copy_only=False), units.flatten().to_numpy(zero_copy_only=False)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def where(self, mask: np.ndarray) -> Block:
        return Block(self.table.filter(pa.array(mask)))

    def entries(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in ``shared`` and value of the entries that are there, by place."""
        place = np.minimum(np.searchsorted(shared, self.id), len(shared) - 1)
        kept = np.flatnonzero(shared[place] == self.id)
        kept = kept[np.argsort(place[kept], kind="stable")]
        return self.row[kept], place[kept], self.unit[kept]


def distances(left: Block, right: Block, itself: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances) of slices of ``left`` to all of ``right``; none is near itself."""
    if not left.size or not right.size:
        return
    shared = np.intersect1d(left.id, right.id)
    (lr, lp, lv), (rr, rp, rv) = left.entries(shared), right.entries(shared)
    rows, width = max(1, CELLS // right.size), max(1, CELLS // max(left.size, right.size))
    for low in range(0, left.size, rows):
        high = min(left.size, low + rows)
        near = np.ones((high - low, right.size))
        for at in range(0, len(shared), width):
            a, b = np.zeros((high - low, min(width, len(shared) - at))), np.zeros((right.size, min(width, len(shared) - at)))
            x, y = slice(*np.searchsorted(lp, [at, at + width])), slice(*np.searchsorted(rp, [at, at + width]))
            own = (lr[x] >= low) & (lr[x] < high)
            a[lr[x][own] - low, lp[x][own] - at] = lv[x][own]
            b[rr[y], rp[y] - at] = rv[y]
            near -= a @ b.T
        np.clip(near, 0.0, 1.0, out=near)
        if itself:
            near[np.arange(high - low), np.arange(low, high)] = np.inf
        yield low, near


def across(vectors: DataFrame, run: Callable[[Block, Block, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` returns for every two blocks of ``vectors``, and for each with itself."""
    n, entries = vectors.agg(F.count("*"), F.sum(F.size("ids"))).first()
    blocks = max(LEAST, min(BLOCKS, -(-n // ROWS)), -(-(entries or 0) // ENTRIES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        itself = table.column("i")[0] == table.column("j")[0]
        left = Block(table.filter(pc.invert(table.column("second"))))
        yield from run(left, left if itself else Block(table.filter(table.column("second"))), itself)

    own, other = F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = vectors.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select(*vectors.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    # a number of its own, as tasks that read little would be made one
    return dealt.repartition(min(TASKS, blocks * (blocks + 1) // 2), "i", "j").groupBy("i", "j").applyInArrow(task, schema)


def close(vectors: DataFrame, eps: float, name: str) -> DataFrame:
    """(a, b, dist), a < b by ``name``, of all pairs up to ``eps``."""

    def run(left: Block, right: Block, itself: bool) -> Iterator[pa.RecordBatch]:
        ours, theirs = left.table.column(name).combine_chunks(), right.table.column(name).combine_chunks()
        for low, dist in distances(left, right, itself):
            r, c = np.nonzero(dist <= eps)
            if itself:
                r, c = r[r + low < c], c[r + low < c]
            for at in range(0, len(r), BATCH):
                x, y = r[at : at + BATCH], c[at : at + BATCH]
                a, b = ours.take(pa.array(x + low)), theirs.take(pa.array(y))
                first = pc.less(a, b)
                yield pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(dist[x, y])], ["a", "b", "dist"])

    return across(vectors.select("at", name, "ids", "units"), run, "a string, b string, dist double")


def reach(vectors: DataFrame, eps: float) -> DataFrame:
    """at and others: the sessions (``n``) of other sequences up to ``eps``, for sequences that have any."""

    def run(left: Block, right: Block, itself: bool) -> Iterator[pa.RecordBatch]:
        n, m, back = left.column("n").astype(float), right.column("n").astype(float), np.zeros(right.size)
        sums = np.zeros(left.size)
        for low, dist in distances(left, right, itself):
            near = (dist <= eps).astype(float)
            sums[low : low + len(near)] = near @ m
            back += n[low : low + len(near)] @ near
        for side, found in ((left, sums),) if itself else ((left, sums), (right, back)):
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(side.column("at")[some]), pa.array(found[some].astype(np.int64))], ["at", "others"])

    return across(vectors.select("at", "n", "ids", "units"), run, "at bigint, others bigint").groupBy("at").agg(F.sum("others").alias("others"))


def nearest(vectors: DataFrame, k: int) -> DataFrame:
    """at, dist, m: the ``k`` nearest others in each block, for sequences that have not ``k`` other sessions themselves."""

    def run(left: Block, right: Block, itself: bool) -> Iterator[pa.RecordBatch]:
        for whole, far in ((left, right),) if itself else ((left, right), (right, left)):
            lacking = whole.column("n") <= k
            near = whole if itself else whole.where(lacking)
            at, m = near.column("at"), far.column("n")
            for low, dist in distances(near, far, itself):
                few = np.argpartition(dist, k - 1, axis=1)[:, :k] if k < far.size else np.broadcast_to(np.arange(far.size), dist.shape)
                away = np.take_along_axis(dist, few, axis=1)
                kept = np.isfinite(away) & (lacking[low : low + len(dist), None] if itself else True)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(at[low : low + len(dist), None], few.shape)[kept]), pa.array(away[kept]), pa.array(m[few][kept])], ["at", "dist", "m"])

    return across(vectors.select("at", "n", "ids", "units"), run, "at bigint, dist double, m bigint")


def links(vectors: DataFrame, eps: float) -> DataFrame:
    """(a, b) of a forest for every two blocks: it connects what pairs up to ``eps`` connect there."""

    def run(left: Block, right: Block, itself: bool) -> Iterator[pa.RecordBatch]:
        at = left.column("at") if itself else np.concatenate([left.column("at"), right.column("at")])
        root = np.arange(len(at))
        far = root if itself else root[left.size :]
        for low, dist in distances(left, right, itself):
            near = dist <= eps
            for r in np.flatnonzero(near.any(axis=1)):
                found = far[near[r]]
                least = min(found.min(), root[low + r])
                if root[low + r] != least or (found != least).any():
                    root[np.isin(root, np.append(found, root[low + r]))] = least
        moved = np.flatnonzero(root != np.arange(len(at)))
        yield pa.RecordBatch.from_arrays([pa.array(at[moved]), pa.array(at[root[moved]])], ["a", "b"])

    return across(vectors.select("at", "ids", "units"), run, "a bigint, b bigint")


def least_cluster(vectors: DataFrame, eps: float) -> DataFrame:
    """at and cluster: the first cluster of those up to ``eps``, for sequences without one (-1) that have any near."""

    def run(left: Block, right: Block, itself: bool) -> Iterator[pa.RecordBatch]:
        for whole, other in ((left, right),) if itself else ((left, right), (right, left)):
            near, far = whole.where(whole.column("cluster") < 0), other.where(other.column("cluster") >= 0)
            none, cluster = np.iinfo(np.int32).max, far.column("cluster")
            for low, dist in distances(near, far, False):
                best = np.where(dist <= eps, cluster, none).min(axis=1)
                some = np.flatnonzero(best < none)
                yield pa.RecordBatch.from_arrays([pa.array(near.column("at")[low + some]), pa.array(best[some].astype(np.int32))], ["at", "cluster"])

    return across(vectors.select("at", "cluster", "ids", "units"), run, "at bigint, cluster int").groupBy("at").agg(F.min("cluster").alias("cluster"))
