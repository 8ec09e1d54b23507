"""Texts of a block as flat arrays: bytes in a row with lengths, chunks of them encoded once, digests of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at a time; a longer text is a block of its own.
BLOCK_BYTES = 4_000_000
#: Chunks that a worker remembers before it forgets them all.
REMEMBERED = 400_000

WHITE, CUT = np.zeros(256, bool), np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
CUT[[32, *range(9, 13)]] = True  # pieces of some vocabularies have a carriage return behind other characters


def runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of the slices ``starts[i] : starts[i] + lens[i]``, in a row."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` values, 0 for a group of none."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The first column, the UTF-8 bytes of the second and their lengths, for some rows at a time. A null text is empty."""
    for batch in batches:
        raw = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
        if not len(raw):
            continue
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        cuts = np.flatnonzero(np.diff((offsets[1:] - offsets[0] - 1).clip(0) // size, prepend=0)).tolist()
        for at, end in zip([0, *cuts], [*cuts, len(raw)], strict=True):
            if at < end:
                yield batch.column(0).slice(at, end - at), data[offsets[at] : offsets[end]], np.diff(offsets[at : end + 1])


def with_space(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each text that is not empty, and the new lengths."""
    grown = lens + (lens > 0)
    body = np.full(int(grown.sum()), 32, np.uint8)
    body[runs(np.cumsum(grown) - lens, lens)] = data
    return body, grown


def chunk_starts(body: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Where texts begin, and ASCII white space but carriage returns after a character that is none.

    Characters led by C2 or E1 to E3 count as white space here, for some of them are.
    """
    white = WHITE[body]
    solid = ~white
    solid[1:] &= body[:-1] != 0xC2
    solid[2:] &= (body[:-2] < 0xE1) | (body[:-2] > 0xE3)
    cut = np.zeros(len(body), bool)
    cut[1:] = solid[:-1] & CUT[body[1:]]
    cut[(np.cumsum(lens) - lens)[lens > 0]] = True
    return np.flatnonzero(cut)


class Coded(NamedTuple):
    """Texts as chunks: the distinct ones, which of them stand in a row, and how many each text has."""

    chunks: list[bytes]
    chunk: np.ndarray
    counts: np.ndarray


def coded(body: np.ndarray, lens: np.ndarray) -> Coded:
    """``body`` and ``lens`` are as ``with_space`` makes them."""
    starts = chunk_starts(body, lens)
    if not len(starts):
        return Coded([], starts, np.zeros(len(lens), np.int64))
    offsets = np.append(starts, len(body)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    ends = np.cumsum(lens)
    return Coded(found.dictionary.to_pylist(), found.indices.to_numpy(), np.searchsorted(starts, ends) - np.searchsorted(starts, ends - lens))


class Remembered:
    """Token ids of texts, with each chunk encoded once by ``encode``: chunks to all their ids in a row and the counts."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = REMEMBERED) -> None:
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def where(self, chunks: list[bytes]) -> np.ndarray:
        new = [c for c in chunks if c not in self.at]
        if len(self.at) + len(new) > self.limit:
            self.forget()
            new = chunks
        if new:
            ids, lens = self.encode(new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
            self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        return np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))

    def of(self, coded: Coded) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if not len(coded.chunk):
            return np.zeros(0, np.int32), np.zeros(len(coded.counts), np.int64)
        chunk = self.where(coded.chunks)[coded.chunk]
        return self.ids[runs(self.starts[chunk], self.lens[chunk])], sums(self.lens[chunk], coded.counts)


def gathered(table: np.ndarray, starts: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bytes of ids in a row; those of id i are ``table[starts[i] : starts[i] + lens[i]]``."""
    return table[runs(starts[ids], lens[ids])]


def byte_table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries as one array of bytes, with starts and lengths."""
    lens = np.array([len(e) for e in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(lens) - lens, lens


class Decimals:
    """Decimal ids, each followed by a separator."""

    def __init__(self, size: int) -> None:
        text = [str(i).encode() for i in range(size)]
        self.lens = np.array([len(t) for t in text], np.int64)
        longest = int(self.lens.max())
        self.digits = np.frombuffer(b"".join(t.ljust(longest) for t in text), np.uint8).reshape(size, longest)

    def write(self, ids: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and how many each id takes."""
        lens = self.lens[ids]
        ends = np.cumsum(lens + 1)
        at = ends - lens - 1
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        for place in range(self.digits.shape[1]):
            there = lens > place
            out[at[there] + place] = self.digits[ids[there], place]
        out[ends - 1] = separators
        return out, lens + 1


def sha256_each(body: np.ndarray, lens: np.ndarray, drop: int = 0) -> list[str]:
    """Lowercase SHA-256 of each slice, without the last ``drop`` bytes of one that is not empty."""
    raw, ends = memoryview(np.ascontiguousarray(body)), np.cumsum(lens)
    return [hashlib.sha256(raw[b : max(b, e - drop)]).hexdigest() for b, e in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
