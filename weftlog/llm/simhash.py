"""SimHash near-dedup with BK-trees.

A document's fingerprint sums the bits of its shingles' hashes. Equal fingerprints are one node. Nodes are
sharded so that two nodes within the radius meet in at least one shard: the 64 bits are cut into m blocks,
and a node goes to one shard for every choice of m - radius blocks, keyed by their bits; at most ``radius``
blocks can differ. Each shard builds a BK-tree (a child's edge is labelled with its Hamming distance to the
parent), and each node searches that tree, following only edges whose label lies within the radius of its
distance to the parent. A shard too large for a task is cut into slices, any two of which meet. Trees together grow with the data, so each goes by key to the one task that asks
it and none is broadcast to all. A shard passes on a spanning star of what it linked, never all pairs.

A fingerprint of 64 bits is too coarse to tell a similarity of 0.8 from one of 0.6. ``similar_groups`` takes
512 bits of a text's distinct shingles to find candidates only, within ``ERRORS`` standard errors of the
distance of the wanted Jaccard similarity, and links what has that similarity by the shingles themselves.
Within such a radius blocks are no use; a shard is keyed by a few sampled bits instead, in so many tables
that a pair one standard error beyond the wanted similarity meets in at least one with a chance of ``RECALL``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import combinations
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import few, join_hot, working, written

SEED = 42
ROWS = 256
#: Shingles hashed at a time, so that a very long text needs no more memory than a short one.
PIECE = 20_000
#: Nodes in a task.
TASK_NODES = 40_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of 64 bits in a wide fingerprint, and the chance to meet at the radius.
WIDE, RECALL = 8, 0.99
#: Visits of tree nodes at a time; shards above this size are looked at for one dense group first.
VISITS, DENSE = 2_000_000, 512
#: Standard errors that a candidate's distance may be beyond the wanted one's.
ERRORS = 3
#: Shingles of a slice of a candidate group, and pivots in a round for groups of more than one slice.
SLICE, PIVOTS = 100_000, (16, 128, None)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The SimHash of a text, as a signed integer of 64 bits: a bit is 1 if set in over half the hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        some = words[at : min(at + PIECE, n) + size - 1]
        grams = map(b" ".join, zip(*(some[k:] for k in range(size)), strict=False)) if len(some) >= size else [b" ".join(some)]
        hashes = np.array([xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
        ones += unpacked(hashes[:, None])
    bits = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return int(bits.astype(np.int64))


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """doc and print of each row, and its ``key`` if one is named."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, size) for at in range(0, batch.num_rows, ROWS) for t in batch.column(1).slice(at, ROWS).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64()), *batch.columns[2:]], names=["doc", "print", *["key"][: batch.num_columns - 2]])

    more = [F.col(key).alias("key")] if key else []
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"), *more).mapInArrow(run, "doc bigint, print bigint" + (", key binary" if key else ""))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, a row of words each."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Trees:
    """BK-trees of many keys at once, as flat arrays: node values, and edges sorted by (parent, label)."""

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        order = np.lexsort((*value.T, key))
        self.key, self.value, self.bits = key[order], value[order], 64 * value.shape[1]
        n = len(order)
        parent, label = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        first = np.r_[True, self.key[1:] != self.key[:-1]] if n else np.zeros(0, bool)
        self.first = np.flatnonzero(first)
        self.size = np.diff(np.r_[self.first, n])
        self.tree = np.cumsum(first) - 1
        self.root = self.first[self.tree]
        waiting = np.flatnonzero(~first)
        at = self.root[waiting]
        # one level a pass: of the nodes that wait at a parent with one distance, the first becomes the child
        while len(waiting):
            d = apart(self.value[waiting], self.value[at])
            order = np.lexsort((waiting, d, at))
            waiting, at, d = waiting[order], at[order], d[order]
            new = np.r_[True, (at[1:] != at[:-1]) | (d[1:] != d[:-1])]
            child = waiting[np.flatnonzero(new)[np.cumsum(new) - 1]]
            parent[waiting[new]], label[waiting[new]] = at[new], d[new]
            waiting, at = waiting[~new], child[~new]
        edges = np.flatnonzero(parent >= 0)
        code = parent[edges] * (self.bits + 1) + label[edges]
        order = np.argsort(code, kind="stable")
        self.edges, self.code = edges[order], code[order]

    def search(self, who: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (searching node, found node) within the radius, level by level; pairs of a node with itself too."""
        at = self.root[who]
        while len(who):
            d = apart(self.value[who], self.value[at])
            hit = d <= radius
            yield who[hit], at[hit]
            low = np.searchsorted(self.code, at * (self.bits + 1) + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.code, at * (self.bits + 1) + np.minimum(d + radius, self.bits), "right") - low
            who = np.repeat(who, n)
            at = self.edges[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]

    def dense(self, radius: int) -> Iterator[np.ndarray]:
        """Of each large tree, the nodes within half the radius of its bitwise majority: all within the radius of each other."""
        for i in np.flatnonzero(self.size > DENSE):
            nodes = np.arange(self.first[i], self.first[i] + self.size[i])
            ones = np.zeros(self.bits, np.int64)
            for at in range(0, len(nodes), PIECE):
                ones += unpacked(self.value[nodes[at : at + PIECE]])
            centre = np.packbits(2 * ones > len(nodes), bitorder="little").view("<u8")[None]
            close = nodes[apart(self.value[nodes], centre) <= radius // 2]
            if len(close) > 1:
                yield close


def unpacked(words: np.ndarray) -> np.ndarray:
    """How many of the rows have each bit set."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def stars(key: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, first value of its group) among values of a key that hang together within the radius.

    ``value`` has a row of words for each node. Nodes of a dense group are linked as they are and need not
    search; all others do, and find those too.
    """
    trees = Trees(key, value)
    n = len(trees.value)
    group, searching = np.arange(n), np.ones(n, bool)
    for close in trees.dense(radius):
        group[close], searching[close] = close[0], False
    who = np.flatnonzero(searching)
    turn = np.cumsum(trees.size[trees.tree[who]]) // VISITS
    for some in np.split(who, np.flatnonzero(np.diff(turn)) + 1) if len(who) else []:
        for a, b in trees.search(some, radius):
            a, b = a[a != b], b[a != b]
            while len(a):
                ga, gb = group[a], group[b]
                differ = ga != gb
                if not differ.any():
                    break
                a, b, ga, gb = a[differ], b[differ], ga[differ], gb[differ]
                np.minimum.at(group, np.maximum(ga, gb), np.minimum(ga, gb))
                while True:
                    up = group[group]
                    if (up == group).all():
                        break
                    group = up
    far = np.flatnonzero(group != np.arange(n))
    return trees.value[far], trees.value[group[far]]


def block_choices(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each key: the (shift, width) of its blocks. More nodes take more blocks, so that keys stay selective.

    A key then has at least log2(n) - 8 bits, but for m = 7 + radius blocks, beyond 2 ** 50 nodes.
    """
    for m in range(radius + 1, radius + 8):
        widths = [64 // m + (i < 64 % m) for i in range(m)]
        blocks = [(sum(widths[:i]), w) for i, w in enumerate(widths)]
        keys = [list(c) for c in combinations(blocks, m - radius)]
        if min(sum(w for _, w in k) for k in keys) >= np.log2(max(n, 1)) - 8:
            break
    return keys


def cells(keyed: DataFrame) -> DataFrame:
    """(key, print), where a key of over ``TASK_NODES`` nodes is cut: two slices at a time meet under a key of their own."""
    many = few(written(keyed.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > TASK_NODES).select("key", F.ceil(F.col("c") / TASK_NODES).cast("int").alias("slices")), "shards"))
    mine = F.pmod(F.xxhash64("print"), F.col("slices")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda other: F.xxhash64("key", F.least(mine, other), F.greatest(mine, other)))
    return keyed.join(many, "key", "left").select(F.explode(F.when(F.col("slices").isNull(), F.array("key")).otherwise(pair)).alias("key"), "print")


def links(nodes: DataFrame, n: int, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``print``) that connect all that lie within the radius."""
    choices = block_choices(n, radius)
    tasks = max(1, n * len(choices) // TASK_NODES + 1)

    def key(i: int, blocks: list[tuple[int, int]]):
        parts = [F.shiftrightunsigned("print", shift).bitwiseAND((1 << w) - 1) for shift, w in blocks]
        return F.xxhash64(F.lit(i), *parts)

    keyed = cells(nodes.select("print", F.explode(F.array(*[key(i, b) for i, b in enumerate(choices)])).alias("key")))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        a, b = stars(table.column("key").to_numpy(), table.column("print").to_numpy().view(np.uint64)[:, None], radius)
        return pa.table([pa.array(x[:, 0].view(np.int64)) for x in (a, b)], schema=out)

    found = keyed.groupBy(F.pmod("key", F.lit(tasks)).alias("task")).applyInArrow(run, "a bigint, b bigint")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``edges`` (a, b), by large and small stars.

    Every round is written; groups are minima, which combine before the shuffle.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        joined = join_hot(both, least, "a", "n", total, F.xxhash64("b"), "inner")
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a != b")

    now = written(edges.filter("a != b").select("a", "b"), "edges")
    before, total = None, now.count()
    while True:
        now = written(star(star(now, True).distinct(), False).distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, total = state, state[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(docs: DataFrame, radius: int = 3, size: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc, print (signed) and component (smallest id reachable by links).

    A null or wordless text has fingerprint 0 and links like any other. Null ids are no component's
    smallest unless it has no other. An empty table gives no rows.
    """
    return grouped(written(fingerprints(docs, size, id_col, text), "prints"), lambda nodes, n: components(links(nodes, n, radius)))


def grouped(prints: DataFrame, linked: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """doc, print and component of each row of ``prints``; ``linked`` gives the components of distinct prints."""
    nodes = written(prints.groupBy("print").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "nodes")
    roots = linked(nodes.select("print"), nodes.count()).withColumnRenamed("node", "print")
    rooted = written(nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("m"))
    labels = join_hot(rooted, least, "root", "m", rooted.count(), F.xxhash64("print"), "inner").select("print", "n", "component")
    return join_hot(prints, labels, "print", "n", prints.count(), F.xxhash64("doc")).select("doc", "print", "component")


def row_key(id_col: str, text: str):
    """What tells rows apart: SHA-256 of the id and the text, a null text being empty."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)), 256))


def keep_first(docs: DataFrame, radius: int = 3, size: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each group that stays: the one with the smallest id, of equal ids one by its text."""
    keyed = docs.withColumn("__key", row_key(id_col, text))
    rows = written(fingerprints(keyed, size, id_col, text, "__key").withColumnRenamed("print", "node"), "prints")
    nodes = written(rows.select(F.col("node").alias("print")).distinct(), "nodes")
    return firsts(docs, rows, components(links(nodes, nodes.count(), radius)), id_col, text)


def firsts(docs: DataFrame, rows: DataFrame, roots: DataFrame, id_col: str, text: str) -> DataFrame:
    """Of ``docs`` the first row of each group, equal rows once; ``rows`` has doc, key and node, ``roots`` the nodes that are linked.

    A null id comes first only where there is no other.
    """
    def first(groups):
        return groups.agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key")).alias("m"))

    nodes = first(rows.groupBy("node")).select("node", "m.doc", "m.key").join(roots, "node", "left")
    keys = written(first(nodes.groupBy(F.coalesce("root", "node").alias("root"))).select(F.col("m.key").alias("__key")), "firsts")
    return docs.withColumn("__key", row_key(id_col, text)).join(keys, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def radius_of(similarity: float, errors: float = 1) -> int:
    """The distance of wide fingerprints at this Jaccard similarity, and some standard errors more."""
    bits = 64 * WIDE
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * share + errors * sqrt(bits * share * (1 - share)))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of words, A-Z in lower case; none for a null or wordless text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), "<u8"))


def wide_print(hashes: np.ndarray) -> bytes:
    if not len(hashes):
        return bytes(8 * WIDE)
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), PIECE):
        some = hashes[at : at + PIECE, None] + np.arange(1, WIDE + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # splitmix64
            some = (some ^ some >> np.uint64(shift)) * np.uint64(factor)
        ones += unpacked(some ^ some >> np.uint64(31))
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def tables_of(n: int, radius: int) -> np.ndarray:
    """Which bits make a key, for each table: about 64 unlike nodes of ``n`` share one."""
    bits = 64 * WIDE
    width = min(40, max(4, ceil(log2(max(n, 2))) - 6))
    tables = ceil(log(1 - RECALL) / log(1 - (1 - radius / bits) ** width))
    rng = np.random.default_rng(SEED)
    return np.array([rng.choice(bits, width, replace=False) for _ in range(tables)])


def wide_links(nodes: DataFrame, n: int, radius: int, meeting: int) -> DataFrame:
    """Links (a, b) between distinct wide fingerprints (column ``print``) that connect those within the radius; tables are for ``meeting``."""
    chosen = tables_of(n, meeting)
    weights = 1 << np.arange(chosen.shape[1], dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                prints = batch.column(0).slice(at, ROWS)
                bits = np.unpackbits(np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
                for i, places in enumerate(chosen):
                    yield pa.record_batch([pa.array((i << chosen.shape[1]) + bits[:, places] @ weights), prints], names=["key", "print"])

    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        value = np.frombuffer(b"".join(table.column("print").to_pylist()), "<u8").reshape(-1, WIDE)
        return pa.table([pa.array([x.tobytes() for x in v], pa.binary()) for v in stars(table.column("key").to_numpy(), value, radius)], schema=out)

    tasks = n * len(chosen) // TASK_NODES + 1
    keyed = cells(nodes.select("print").mapInArrow(deal, "key bigint, print binary"))
    return keyed.groupBy(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task")).applyInArrow(run, "a binary, b binary").distinct()


def jaccard_links(rows: list[tuple[bytes, bytes, bytes]], pivots: list[tuple[bytes, bytes, bytes]], similarity: float, radius: int) -> list[tuple[bytes, bytes]]:
    """Links (a, b) that connect each of the pivots (node, print, hashes) with all rows that have the similarity with it."""
    prints = np.frombuffer(b"".join(r[1] for r in rows), "<u8").reshape(-1, WIDE)
    sets = [np.frombuffer(r[2], "<u8") for r in rows]
    n = np.array([len(x) for x in sets])
    group = {r[0]: r[0] for r in (*rows, *pivots)}

    def find(x: bytes) -> bytes:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    found = []
    for node, mark, hashes in pivots:
        mine = np.frombuffer(hashes, "<u8")
        may = (np.minimum(n, len(mine)) >= similarity * np.maximum(n, len(mine)) - 1e-9) & (apart(prints, np.frombuffer(mark, "<u8")[None]) <= radius)
        for i in np.flatnonzero(may):
            a, b = find(node), find(rows[i][0])
            if a != b:
                both = len(np.intersect1d(mine, sets[i], assume_unique=True))
                if both >= similarity * (len(mine) + n[i] - both) - 1e-9:
                    group[max(a, b)] = min(a, b)
                    found.append((node, rows[i][0]))
    return found


def exact_links(sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) that connect what has the similarity within each candidate group (root, node, print, hashes, n).

    A pivot is compared with its whole group. In a group of one slice all are pivots. In a larger one a few
    are, then some more, then all that are not in the group's largest part yet: at the end no pair of two
    parts is left that was not compared, and those within a part need not be.
    """
    groups = sets.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).withColumn("slices", F.ceil(F.col("total") / SLICE).cast("int"))
    groups = written(groups.withColumn("slices", F.greatest("slices", F.lit(1))), "groups")
    tasks = int(sets.agg(F.sum("n")).first()[0] or 0) // (2 * SLICE) + 8
    dealt = join_hot(sets, groups, "root", "m", sets.count(), F.xxhash64("node"), "inner").withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"))
    dealt = written(dealt.withColumn("draw", F.pmod(F.xxhash64("node"), F.col("m"))), "sets")
    large = dealt.filter("slices > 1")
    ddl, out = "a binary, b binary", pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        cells: dict = {}
        for side, *cell in zip(*(table.column(c).to_pylist() for c in ("side", "root", "slice", "block", "node", "print", "hashes")), strict=True):
            cells.setdefault(tuple(cell[:3]), ([], []))[side].append(tuple(cell[3:]))
        found = [x for rows, pivots in cells.values() if rows and pivots for x in jaccard_links(rows, pivots, similarity, radius)]
        return pa.table([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], schema=out)

    def compared(rows: DataFrame, pivots: DataFrame) -> DataFrame:
        """Every slice of a group with every block of its pivots."""
        blocks = written(pivots.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / SLICE)).cast("int").alias("blocks"), F.max("m").alias("members")), "blocks")
        total = blocks.agg(F.sum("members")).first()[0] or 0
        beside = lambda some: join_hot(some, blocks, "root", "members", total, F.xxhash64("node"), "inner")
        cell = ["root", "slice", "block", "node", "print", "hashes", F.pmod(F.xxhash64("root", "slice", "block"), F.lit(tasks)).alias("task")]
        left = beside(rows).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.lit(0).alias("side"), *cell)
        right = beside(pivots).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
        right = right.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(F.lit(1).alias("side"), *cell)
        return written(left.union(right).groupBy("task").applyInArrow(run, ddl), "exact")

    small = dealt.filter("slices = 1")
    links = compared(small, small)
    if large.isEmpty():
        return links
    parts = None
    for some in PIVOTS:
        pivots = large
        if parts is not None:
            now = large.select("root", "node").join(components(parts).withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
            now = written(now, "parts")
            most = now.groupBy("root", "part").agg(F.count("*").alias("c")).groupBy("root").agg(F.max(F.struct("c", "part")).alias("most"))
            left = now.join(most, "root").filter(F.col("part") != F.col("most.part")).select("node")
            pivots = large.join(left, "node", "left_semi")
        if some is not None:
            pivots = pivots.filter(F.col("draw") < some)
        found = compared(large, pivots)
        parts = found if parts is None else parts.union(found)
    return links.union(parts)


def similar_rows(docs: DataFrame, similarity: float, size: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """doc, key and node (its set of shingles) of each row, and node and root of each node that is linked."""
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"), row_key(id_col, text).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, ROWS):
                for t in batch.column(1).slice(at, ROWS).to_pylist():
                    hashes = shingles(t, size)
                    found.append((sha256(hashes.tobytes()).digest(), wide_print(hashes)))
            yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array([x[i] for x in found], pa.binary()) for i in (0, 1))], names=["doc", "key", "node", "print"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                sets = [shingles(t, size) for t in some.column(3).to_pylist()]
                yield pa.record_batch([*some.columns[:3], pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], names=["root", "node", "print", "hashes", "n"])

    rows = written(keyed.mapInArrow(run, "doc bigint, key binary, node binary, print binary"), "prints")
    nodes = written(rows.groupBy("node").agg(F.min("key").alias("key"), F.first("print").alias("print")), "nodes")
    prints = written(nodes.select("print").distinct(), "prints")
    radius = radius_of(similarity, ERRORS)
    near = components(wide_links(prints, prints.count(), radius, radius_of(similarity))).withColumnRenamed("node", "print")
    rooted = written(nodes.join(near, "print", "left").withColumn("root", F.coalesce("root", "print")), "candidates")
    several = rooted.groupBy("root").agg(F.count("*").alias("c")).filter("c > 1")
    wanted = written(join_hot(rooted, several, "root", "c", rooted.count(), F.xxhash64("node"), "inner").drop("c"), "candidates")
    texts = keyed.select("key", "text").join(wanted, "key").dropDuplicates(["key"]).select("root", "node", "print", "text")
    sets = written(texts.mapInArrow(again, "root binary, node binary, print binary, hashes binary, n bigint"), "hashes")
    return rows, components(exact_links(sets, similarity, radius))


def similar_groups(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc and component (smallest id reachable by links of the similarity); nulls and empty tables as in ``near_groups``."""
    rows, roots = similar_rows(docs, similarity, size, id_col, text)
    return grouped(rows.select("doc", F.col("node").alias("print")), lambda *_: roots).select("doc", "component")


def keep_dissimilar(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of similar texts the one with the smallest id, of equal ids one by its text."""
    rows, roots = similar_rows(docs, similarity, size, id_col, text)
    return firsts(docs, rows, roots, id_col, text)
