"""Alignment of two tokenizers over a corpus.

Both tokenise the same bytes. A two-pointer merge of their cumulative token ends cuts a text into groups, the
shortest stretches at whose end both end a token, and links every token of one side with every token of the
other inside a group. Counts of linked id pairs over the corpus say which links are systematic.

A task aligns a block of texts and keeps, for each document, its distinct linked pairs as positions in the
block's list of pairs, commonest first, packed to one or two bytes each. That list with its document counts is
all that is shuffled by pair: a pair of every document comes once a block, so no pair is hot. Counts and
maxima are joined to the list, and each block's list returns to its documents in one group of a size that the
block bounds.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm import pieces
from weftlog.llm.common import written
from weftlog.llm.flat import Decimals, Remembered, blocks, byte_table, coded, gathered, runs, sha256_each, sums, with_space

#: Bytes of text that are aligned at a time, and that share a list of pairs; links that are expanded at a time.
ALIGNED_BYTES = 1_000_000
LIST_BYTES = 8_000_000
EXPANDED = 2_000_000
#: Links of a group from which on its equal tokens are counted instead of expanded.
CROWDED = 10_000
#: Ids of the second tokenizer are below this.
SIDE = 1 << 20

ROW_DDL = "block bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, pairs array<struct<pair:bigint,docs:int>>"
PAIR = pa.struct([("pair", pa.int64()), ("docs", pa.int32())])
ROW = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(PAIR))])


class ByteLevel:
    """A byte-level BPE of the tokenizers library, without special tokens, by remembered chunks."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        vocab = self.whole.get_vocab()
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        entries = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            entries[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.table, self.starts, self.lens = byte_table(entries)
        self.chunks = Remembered(self.encode_chunks)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """No token spans chunks, so those that end in a solid character are tokenised in a row and told apart by their bytes."""
        last = np.array([c[-1] for c in chunks])
        solid = (last > 32) & (last < 127)
        row, own = np.flatnonzero(solid), np.flatnonzero(~solid)
        ids = np.array(self.ids([b"".join([chunks[i] for i in row.tolist()]).decode()])[0], np.int32)
        ends, wanted = np.cumsum(self.lens[ids]), np.cumsum(np.array([len(chunks[i]) for i in row.tolist()], np.int64))
        at = np.searchsorted(ends, wanted)
        if len(wanted) and (at[-1] != len(ends) - 1 or not np.array_equal(ends[at], wanted)):
            raise ValueError("the tokenizer has tokens across white space, or changes texts")
        alone = self.ids([chunks[i].decode() for i in own.tolist()])
        lens = np.empty(len(chunks), np.int64)
        lens[row], lens[own] = np.diff(at, prepend=-1), [len(x) for x in alone]
        starts = np.empty(len(chunks), np.int64)
        starts[row], starts[own] = np.cumsum(lens[row]) - lens[row], len(ids) + np.cumsum(lens[own]) - lens[own]
        ids = np.concatenate([ids, np.array([i for x in alone for i in x], np.int32)])
        return ids[runs(starts, lens)], lens


class Aligner:
    """Aligns blocks of texts; ``pack`` ends a list of pairs and gives its rows."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), pieces.Pieces(b_path)
        self.decimals = Decimals(max(len(self.a.lens), self.b.size))
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.bytes_ = 0

    def add(self, ids: pa.Array, data: np.ndarray, lens: np.ndarray) -> None:
        body, grown = with_space(data, lens)
        chunks = coded(body, grown)
        (a, n_a), (b, n_b) = self.a.chunks.of(chunks), self.b.chunks.of(chunks)
        # a text whose tokens do not give it back has none
        same = np.ones(len(lens), bool)
        for side, own, n in ((self.a, a, n_a), (self.b, b, n_b)):
            size = sums(side.lens[own], n)
            same &= size == grown
            fit = np.flatnonzero(same)
            given = gathered(side.table, side.starts, side.lens, own)[runs((np.cumsum(size) - size)[fit], size[fit])]
            wanted = body[runs((np.cumsum(grown) - grown)[fit], grown[fit])]
            same[fit] = sums((given != wanted).astype(np.int64), grown[fit]) == 0
        a, n_a = a[np.repeat(same, n_a)], n_a * same
        b, n_b = b[np.repeat(same, n_b)], n_b * same
        ends_a, ends_b = np.cumsum(self.a.lens[a]), np.cumsum(self.b.lens[b])
        # two pointers: each end of one side against the first end of the other that is not before it
        shared = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a] if len(a) else ends_a
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        per_doc = np.searchsorted(shared, np.cumsum(sums(self.a.lens[a], n_a)), side="right")
        n_groups = np.diff(per_doc, prepend=0)
        doc_of = np.repeat(np.arange(len(lens)), n_groups)
        self.link(a, b, in_a, in_b, doc_of)
        digests = sha256_each(*self.shown(a, b, group_a, group_b, in_a, in_b, n_a + n_b), drop=1)
        n_links = sums(in_a * in_b, n_groups)
        self.rows += zip(ids.to_pylist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), [d if n else "" for d, n in zip(digests, n_a.tolist(), strict=True)], strict=True)
        self.bytes_ += len(data)

    def shown(self, a, b, group_a, group_b, in_a, in_b, counts) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of each text, and the lengths."""
        size = in_a + in_b
        begin = np.cumsum(size) - size
        at_a = np.arange(len(a)) + (begin - (np.cumsum(in_a) - in_a))[group_a]
        at_b = np.arange(len(b)) + (begin - (np.cumsum(in_b) - in_b) + in_a)[group_b]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        marks[begin + in_a - 1], marks[begin + size - 1] = ord("|"), ord(";")
        out, lens = self.decimals.write(ids, marks)
        return out, sums(lens, counts)

    def link(self, a, b, in_a, in_b, doc_of) -> None:
        """Distinct (document, pair) with how often, for the groups in turn."""
        docs, links = len(self.rows) + doc_of, in_a * in_b
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        keys, times = [], []
        for g in np.flatnonzero(links > CROWDED).tolist():
            (x, nx), (y, ny) = (np.unique(side[at : at + n], return_counts=True) for side, at, n in ((a, first_a[g], in_a[g]), (b, first_b[g], in_b[g])))
            keys.append((docs[g] << 40) + (np.repeat(x.astype(np.int64), len(y)) * SIDE + np.tile(y, len(x))))
            times.append(np.repeat(nx, len(y)) * np.tile(ny, len(x)))
        plain = np.flatnonzero(links <= CROWDED)
        turn = np.cumsum(links[plain]) // EXPANDED
        for some in np.split(plain, np.flatnonzero(np.diff(turn)) + 1):
            left = runs(first_a[some], in_a[some])
            other = np.repeat(in_b[some], in_a[some])
            right = runs(np.repeat(first_b[some], in_a[some]), other)
            key = (np.repeat(docs[some], links[some]) << 40) + np.repeat(a[left].astype(np.int64), other) * SIDE + b[right]
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            times.append(n)
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        self.keys.append(key)
        self.times.append(np.bincount(inverse, np.concatenate(times), minlength=len(key)).astype(np.int32))

    def pack(self, block: int) -> Iterator[pa.RecordBatch]:
        """A row with the list of pairs, then the documents' rows."""
        if not self.rows:
            return
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        pair, at, docs = np.unique(key & ((1 << 40) - 1), return_inverse=True, return_counts=True)
        order = np.argsort(-docs, kind="stable")
        place = np.empty(len(pair), np.int64)
        place[order] = np.arange(len(pair))
        doc, at = key >> 40, place[at]
        sort = np.lexsort((at, doc))
        doc, at, times = doc[sort], at[sort], times[sort]
        cuts = np.searchsorted(doc, np.arange(len(self.rows) + 1)).tolist()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        links = [squeeze(packed(at[i:j], times[i:j])) if j > i else None for i, j in zip(cuts, cuts[1:], strict=False)]
        offsets = pa.array([0, len(pair)], pa.int32())
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(pair[order]), pa.array(docs[order], pa.int32())], names=["pair", "docs"]))
        yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.nulls(1, f.type) for f in list(ROW)[1:-1]], listed.cast(ROW.field("pairs").type)], schema=ROW)
        cols = list(zip(*self.rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(self.rows)), *[pa.array(c, f.type) for c, f in zip([*cols, links], list(ROW)[1:-1], strict=True)], pa.nulls(len(self.rows), ROW.field("pairs").type)], schema=ROW)
        self.clear()


def packed(at: np.ndarray, times: np.ndarray) -> bytes:
    """Rising positions as steps and counts, byte by byte of each number, so that they compress well."""
    return np.concatenate([np.diff(at, prepend=0), times]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(a_path: str, b_path: str) -> Aligner:
    """Both tokenizers and what they remember, kept by a worker from task to task; without what a failed task left."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    _LOADED[a_path, b_path].clear()
    return _LOADED[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents and, one a block, of lists of pairs, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block = loaded(a_path, b_path), TaskContext.get().partitionId() << 32
        for id_, data, lens in blocks(batches, ALIGNED_BYTES):
            aligner.add(id_, data, lens)
            if aligner.bytes_ >= LIST_BYTES:
                yield from aligner.pack(block)
                block += 1
        yield from aligner.pack(block)

    return written(pieces.texts_of(docs, id_col, text).mapInArrow(run, ROW_DDL), "aligned")


def pair_counts(listed: DataFrame) -> DataFrame:
    """How many documents hold each linked pair, with the largest count of either side: a, b, docs, best_a, best_b."""
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("docs")).select("pair", (F.col("pair") / SIDE).cast("int").alias("a"), (F.col("pair") % SIDE).cast("int").alias("b"), "docs")
    # one row for each id of a vocabulary
    best = lambda c: F.broadcast(counts.groupBy(c).agg(F.max("docs").alias(f"best_{c}")))
    return counts.join(best("a"), "a").join(best("b"), "b")


def lists(rows: DataFrame) -> DataFrame:
    """The blocks' lists of pairs in long form: block, at, pair, docs."""
    return rows.filter("pairs is not null").select("block", F.posexplode("pairs").alias("at", "p")).select("block", "at", "p.pair", "p.docs")


SCORE_DDL = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, n_best_b bigint, count_sum bigint, groups_sha256 string"


def scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """One block: what its documents' links have in the corpus."""
    n = pairs.num_rows
    at = pairs["at"].to_numpy()
    count, best_a, best_b = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    count[at] = pairs["docs"].to_numpy()
    best_a[at], best_b[at] = pairs["docs"].to_numpy() == pairs["best_a"].to_numpy(), pairs["docs"].to_numpy() == pairs["best_b"].to_numpy()
    open_ = zstandard.ZstdDecompressor().decompress
    sums_: list[tuple[int, int, int]] = []
    for raw in docs["links"].to_pylist():
        here, times = unpacked(open_(raw)) if raw is not None else (np.zeros(0, np.int64),) * 2
        sums_.append((int((times * best_a[here]).sum()), int((times * best_b[here]).sum()), int((times * count[here]).sum())))
    extra = list(zip(*sums_, strict=True)) or [(), (), ()]
    own = [docs[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*own, *[pa.array(c, pa.int64()) for c in extra], docs["groups_sha256"]], names=[c.split()[0] for c in SCORE_DDL.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256.

    ``a_path`` is a byte-level BPE, which gets a space and the text; ``b_path`` a SentencePiece BPE. ``n_best`` counts the
    links whose pair is in as many documents as any pair of its A id (``n_best_b``: of its B id), ties included;
    ``count_sum`` adds the pairs' document counts over all links. A text that is null, empty, or not given back by both
    tokenizers has no tokens: zeros and an empty digest. Rows with the same id or text count as documents of their own.
    An empty table gives no rows; other columns are not read.
    """
    rows = aligned(docs, a_path, b_path, id_col, text)
    listed = lists(rows).repartition("pair")  # once for the counts and for the join
    counts = pair_counts(listed).select("pair", F.col("docs").alias("all_docs"), "best_a", "best_b")
    known = listed.select("block", "at", "pair").join(counts, "pair").select("block", "at", F.col("all_docs").alias("docs"), "best_a", "best_b")
    own = rows.filter("pairs is null").drop("pairs")
    return own.withColumnRenamed("block", "own_block").groupBy("own_block").cogroup(known.groupBy("block")).applyInArrow(scored, SCORE_DDL)
