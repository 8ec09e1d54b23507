"""Hierarchical packing into several context sizes.

Documents are tokenised where they lie. Each is cut into full windows of the longest context, and its rest
is routed to the shortest tier that holds it. Tiers are packed from long to short: a window opens with a
rest of its own tier, its gap is filled with the largest rests of shorter tiers that fit, and at last with
the head of one that is cut, so windows end up full. What is left at the end of a task's rows is packed into
the shortest tiers that it fills, so that at most one window per task has padding.

A task holds the tokens of ``BLOCK_TOKENS`` at a time and carries what it could not place into the next
block, so memory does not depend on the input. Sequences are numbered by partition and ordinal; step groups
are then dealt over the whole result so that each has the same mix of tiers.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.common import keeps, working, written

TIERS = (256, 512, 1024, 2048)
END = 1
BLOCK_TOKENS = 2_000_000
#: Sequences of one step group.
STEP = 64
ROWS = 128
#: Chunks and pieces of chunks that a worker remembers before it forgets them all.
CACHE = 600_000

PIECE_DDL = "doc bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, seq bigint, offset bigint, tier int"
PIECE = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32())])

#: The tokenizer's split, for chunks of ASCII and Latin-1 letters; others go through the whole tokenizer.
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

#: Texts that tell whether a tokenizer splits and joins as ``Ids`` does: case, white space, digits, signs, letters beyond ASCII.
PROBES = ("", "A b  c", "It's  WE'LL 12ab3 x-y!!", "Ünïcödé  ñandú é", "line\n\ttab  end ", "<|x|> \u4e2d\u6587 \u0130", "the the theatre")


def lowered(text: bytes) -> bytes:
    """A-Z in lower case, as the tokenizer would, so that fewer chunks differ.

    A text with combining marks (led by CC or CD) stays, for they join letters before those are lowered, and so
    does one that may name special tokens, which are told by their case.
    """
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


class Ids:
    """Ids of whole texts as little-endian 32-bit bytes, with white-space chunks remembered.

    The tokenizer drops white space and no token spans it, so a text's ids are its chunks' ids in a row. A
    chunk of plain letters is lower-cased and split as the tokenizer does, and the pieces not seen before go
    to its model in one call; their ids are told apart by the vocabulary's word ends.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.split = True
        for probe in PROBES:  # another tokenizer's texts go through it whole
            self.split &= b"".join(self.of([probe])) == self.whole_ids(probe)

    def whole_ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: set[bytes]) -> None:
        if len(self.chunks) + len(new) > CACHE:
            self.chunks = {}
        if len(self.pieces) > CACHE:
            self.pieces = {}
        split: dict[bytes, list[str]] = {}
        for chunk in new:
            text = chunk.decode("utf-8")
            if PLAIN.fullmatch(text) and "<|" not in text:
                split[chunk] = SPLIT.findall(text.lower())
            else:
                self.chunks[chunk] = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        unseen = list({p for pieces in split.values() for p in pieces}.difference(self.pieces))
        if unseen:
            ids = np.array(self.bare.encode_batch_fast([" ".join(unseen)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(unseen) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for piece, cut in zip(unseen, (cuts * 4).tolist(), strict=True):
                    self.pieces[piece] = raw[at:cut]
                    at = cut
            else:
                for piece in unseen:
                    self.pieces[piece] = np.array(self.whole.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        for chunk, pieces in split.items():
            self.chunks[chunk] = b"".join(map(self.pieces.__getitem__, pieces))

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        if not self.split:
            yield from (self.whole_ids(t or "") for t in texts)
            return
        split = [lowered((t or "").encode("utf-8")).split() for t in texts]
        new = set().union(*split).difference(self.chunks)  # looks up the few, where a subtraction of keys walks the cache
        if new:
            self.learn(new if len(new) + len(self.chunks) <= CACHE else set().union(*split))
        for words in split:
            yield b"".join(map(self.chunks.__getitem__, words))


class Packer:
    """Packs one task's documents; ``rows`` collects its pieces."""

    def __init__(self, part: int, tiers: tuple[int, ...]) -> None:
        self.part, self.tiers, self.seq, self.rows = part, tiers, 0, []
        # rests by tier, sorted by length: (length, ordinal); the pieces themselves by ordinal
        self.pool: list[list[tuple[int, int]]] = [[] for _ in tiers]
        self.rest: dict[int, tuple] = {}
        self.ordinal = self.held = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        n, longest, at = len(ids) // 4, self.tiers[-1], 0
        while n - at >= longest:
            self.emit([(doc, at, longest, ids, 0, n)], longest)
            at += longest
        if at < n:
            self.put((doc, at, n - at, ids[4 * at :], at, n))

    def put(self, piece: tuple) -> None:
        tier = next(i for i, size in enumerate(self.tiers) if piece[2] <= size)
        insort(self.pool[tier], (piece[2], self.ordinal))
        self.rest[self.ordinal] = piece
        self.ordinal += 1
        self.held += piece[2]

    def take(self, tier: int, at: int) -> tuple:
        piece = self.rest.pop(self.pool[tier].pop(at)[1])
        self.held -= piece[2]
        return piece

    def emit(self, pieces: list[tuple], tier: int) -> None:
        offset = 0
        for doc, start, length, ids, base, n in pieces:
            crc = zlib.crc32(memoryview(ids)[4 * (start - base) : 4 * (start - base + length)])
            self.rows.append((doc, start, length, crc, n, self.part, self.seq, offset, tier))
            offset += length
        self.seq += 1

    def fill(self, pieces: list[tuple], gap: int, top: int) -> int:
        """Fill a window's gap from tiers up to ``top``: the largest that fit, then the head of one that is cut."""
        while gap:
            for tier in range(top, -1, -1):
                at = bisect_right(self.pool[tier], (gap, 1 << 62)) - 1
                if at >= 0:
                    pieces.append(self.take(tier, at))
                    gap -= pieces[-1][2]
                    break
            else:
                tier = next((i for i in range(top + 1) if self.pool[i]), None)
                if tier is None:
                    return gap
                doc, start, length, ids, base, n = self.take(tier, 0)
                pieces.append((doc, start, gap, ids, base, n))
                self.put((doc, start + gap, length - gap, ids, base, n))
                gap = 0
        return gap

    def pack(self, last: bool) -> None:
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.pool[tier]:
                if self.held < self.tiers[tier]:
                    break
                pieces = [self.take(tier, len(self.pool[tier]) - 1)]
                gap = self.fill(pieces, self.tiers[tier] - pieces[0][2], tier if tier == 0 else tier - 1)
                if gap:  # shorter tiers are used up: fill from its own
                    gap = self.fill(pieces, gap, tier)
                self.emit(pieces, self.tiers[tier])
        while last and self.held:
            full = [size for size in self.tiers if size <= self.held]
            top = len(self.tiers) - 1
            pieces: list[tuple] = []
            self.fill(pieces, full[-1] if full else self.held, top)
            self.emit(pieces, full[-1] if full else self.tiers[top])

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in PIECE]
        self.rows = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, PIECE, strict=True)], schema=PIECE)


_IDS: dict[str, Ids] = {}
keeps("packing", _IDS.clear)


def loaded(path: str) -> Ids:
    """The tokenizer and what it remembers, kept by a worker from task to task; a task's own function would get a copy."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def _pack(path: str, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        working("packing")
        ids = loaded(path)
        packer, end, since = Packer(TaskContext.get().partitionId(), tiers), np.array([END], "<u4").tobytes(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                docs, texts = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
                for doc, raw in zip(docs, ids.of(texts), strict=True):
                    packer.add(doc, raw + end)
                    since += len(raw) // 4 + 1
                if since >= BLOCK_TOKENS:
                    packer.pack(last=False)
                    yield packer.batch()
                    since = 0
        packer.pack(last=True)
        yield packer.batch()

    return run


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, step: int = STEP, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, padding, step_group.

    ``tiers`` are powers of two. A window is full, and then not padded, but for at most one of each task,
    which is padded to the longest. A null text is empty: its document is the end id alone. Rows with the same id are
    packed apart. An empty table gives no rows.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers are powers of two in rising order")
    pieces = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(_pack(tokenizer_path, tiers), PIECE_DDL)
    pieces = written(pieces, "pieces")
    # step groups: the sequence at rank r of a tier's n goes to group floor(r * groups / n)
    counts = pieces.filter("offset = 0").groupBy("part", "tier").agg(F.count("*").alias("n"))
    order = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    counts = counts.select("part", "tier", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("tier")).alias("all"))
    groups = max(1, -(-pieces.filter("offset = 0").count() // step))
    rank = F.dense_rank().over(Window.partitionBy("part", "tier").orderBy("seq")) - 1
    used = F.sum("length").over(Window.partitionBy("part", "seq"))
    ranked = pieces.withColumns({"rank": rank, "used": used}).join(counts, ["part", "tier"])
    group = F.expr(f"(before + rank) * {groups} div all").cast("bigint")
    window = F.when(F.col("used") == F.col("tier"), F.col("tier")).otherwise(tiers[-1])
    return ranked.select("doc", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft(F.col("part").cast("bigint"), 36) + F.col("seq")).alias("sequence_id"), "offset", "tier", (window - F.col("used")).alias("padding"), group.alias("step_group"))
