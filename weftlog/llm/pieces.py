"""SentencePiece encoding and decoding of a BPE model by vectorised merge rounds.

A text with a space before it is cut where white space follows other characters; no piece of the vocabulary
crosses such a place. The chunks not seen before are encoded together, as one flat array of symbols: each
round takes the least rank of each chunk's adjacent pairs, merges all its occurrences at once (of overlapping
ones every other from the left), closes the gaps, and looks up only the pairs that changed; a chunk without a
pair left leaves. Where a merge would put a better pair beside it, which the library would merge before the
other occurrences, the chunk merges the first occurrence alone in that round. Characters outside the vocabulary become their bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.flat import Decimals, Remembered, blocks, byte_table, coded, gathered, runs, sha256_each, sums, with_space

SPACE = "▁"
NEVER = np.iinfo(np.int32).max
#: Symbols from which on a chunk is merged with a heap, in time that does not grow with rounds times length.
LONG = 500
#: Probes of the loaded model against the library: spaces, other white space, ligatures, what is outside the vocabulary.
PROBES = ("", " ", "a  b ", " \tx\n\n y", "ﬁ ▁▁ z", "<s> \U0001f9a6\x00́e", "the theatre  ....... aaaaaaaaa 12345", "中文  x")


class Pieces:
    """A SentencePiece BPE model with byte fallback, a dummy prefix and no other normalisation; others raise ValueError."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        n = self.size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        plain = [not (byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        if sum(byte) != 256 or any(re.search(rf"[^{SPACE}][{SPACE}\t-\f ]", x) for x, p in zip(names, plain, strict=True) if p):
            raise ValueError("needs byte fallback, and pieces with white space in front only")
        self.bytes_ = np.zeros(256, np.int64)
        for i in np.flatnonzero(byte).tolist():
            self.bytes_[int(names[i][3:5], 16)] = i
        entries = [bytes([int(x[3:5], 16)]) if byte[i] else x.replace(SPACE, " ").encode() if plain[i] else b"" for i, x in enumerate(names)]
        self.table, self.starts, self.lens = byte_table(entries)
        self.special = np.array([not p and not sp.is_control(i) for i, p in enumerate(plain)])
        self.spaced = np.array([p and x.startswith(SPACE) for x, p in zip(names, plain, strict=True)])
        # symbols: ids of pieces; a character outside the vocabulary is n + its code point
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        ids = {x: i for i, (x, p) in enumerate(zip(names, plain, strict=True)) if p}
        for x, i in ids.items():
            if len(x) == 1:
                self.symbol[ord(x)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        scores = sorted({sp.get_score(i) for i in ids.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(n, NEVER, np.int64)
        for i in ids.values():
            self.rank[i] = order[sp.get_score(i)]
        # all ways to put two pieces together, and the pieces that are worse than one made from them
        made: dict[int, int] = {}
        hasty = np.zeros(n, bool)
        for x, i in ids.items():
            for cut in range(1, len(x)):
                left, right = ids.get(x[:cut]), ids.get(x[cut:])
                if left is not None and right is not None:
                    made[left << 21 | right] = i
                    for part in (left, right):
                        hasty[part] |= self.rank[part] >= self.rank[i]
        self.one_by_one = np.zeros(len(scores) + 1, bool)
        self.one_by_one[self.rank[hasty & (self.rank < NEVER)]] = True
        # open addressing: a power of two with three quarters free
        bits = max(4, (4 * len(made) - 1).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        keys, values = np.fromiter(made.keys(), np.int64, len(made)), np.fromiter(made.values(), np.int64, len(made))
        slots = self.slot(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]], self.values[slots[free]] = keys[free], values[free]
            left = self.keys[slots] != keys
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & self.mask
        self.decimals = Decimals(n)
        self.chunks = Remembered(self.encode_chunks)
        for probe in PROBES:
            if self.encode([probe])[0].tolist() != sp.encode(probe):
                raise ValueError("the model is no BPE model, or it normalises texts")

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def put_together(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair, -1 and NEVER where the vocabulary has none."""
        found, ranks = np.full(len(left), -1, np.int64), np.full(len(left), NEVER, np.int64)
        asked = np.arange(len(left))
        keys = left << 21 | right
        slots = self.slot(keys)
        while len(asked):
            there = self.keys[slots]
            hit = there == keys
            got = self.values[slots[hit]]
            found[asked[hit]], ranks[asked[hit]] = got, self.rank[got]
            on = ~hit & (there >= 0)
            asked, keys, slots = asked[on], keys[on], (slots[on] + 1) & self.mask
        return found, ranks

    def betters(self, symbols, word, made, rank, at, asked) -> np.ndarray:
        """Which merges ``at[asked]`` put a symbol beside a neighbour, or beside the next merge's, that it pairs with as well or better."""
        here = at[asked]
        found = np.zeros(len(here), bool)
        for own, left, right in ((here > 0, here - 1, None), (here + 2 < len(word), None, here + 2)):
            other = left if right is None else right
            some = np.flatnonzero(own)
            some = some[word[other[some]] == word[here[some]]]
            pair = (symbols[other[some]], made[here[some]]) if right is None else (made[here[some]], symbols[other[some]])
            found[some] |= self.put_together(*pair)[1] <= rank[here[some]]
        some = np.flatnonzero(asked + 1 < len(at))
        after = at[asked[some] + 1]
        near = (after == here[some] + 2) & (word[after] == word[here[some]])
        some, after = some[near], after[near]
        found[some] |= self.put_together(made[here[some]], made[after])[1] <= rank[here[some]]
        return found

    def merged(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left when no pair remains, and how many each chunk has. All of ``lens`` are 1 or more."""
        word = np.repeat(np.arange(len(lens)), lens)
        done_word, done_symbol = [], []
        made, rank = np.full(len(symbols), -1, np.int64), np.full(len(symbols), NEVER, np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        made[inner], rank[inner] = self.put_together(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(first, append=len(word))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == NEVER, size)
            done_word.append(word[over])
            done_symbol.append(symbols[over])
            hit = (rank == np.repeat(least, size)) & ~over
            at = np.flatnonzero(hit)
            # of hits in a row every other one, from the left
            opens = np.diff(at, prepend=-2) > 1
            begin = np.maximum.accumulate(np.where(opens, at, 0))
            at = at[(at - begin) % 2 == 0]
            asked = np.flatnonzero(self.one_by_one[rank[at]])
            if len(asked):
                alone = np.isin(word[at], word[at[asked[self.betters(symbols, word, made, rank, at, asked)]]])
                at = at[~alone | (np.diff(word[at], prepend=-1) != 0)]
            symbols[at] = made[at]
            gone = over
            gone[at + 1] = True
            fresh = np.zeros(len(symbols), bool)
            fresh[at] = True
            symbols, word, made, rank, fresh = symbols[~gone], word[~gone], made[~gone], rank[~gone], fresh[~gone]
            fresh[:-1] |= fresh[1:]  # a merged symbol's pairs are its own and its left neighbour's
            new = np.flatnonzero(fresh)
            made[new], rank[new] = -1, NEVER
            new = new[new + 1 < len(word)]
            new = new[word[new] == word[new + 1]]
            made[new], rank[new] = self.put_together(symbols[new], symbols[new + 1])
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lens))

    def merged_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one chunk, best pair first, from a heap."""
        value = symbols.tolist()
        before, after = list(range(-1, len(value) - 1)), [*range(1, len(value)), -1]
        piece, rank = self.put_together(symbols[:-1], symbols[1:])
        heap = [(r, i, v, value[i], value[i + 1]) for i, (v, r) in enumerate(zip(piece.tolist(), rank.tolist(), strict=True)) if v >= 0]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(i: int, j: int) -> None:
            pair = value[i], value[j]
            if pair not in known:
                v, r = self.put_together(np.array(pair[:1]), np.array(pair[1:]))
                known[pair] = int(v[0]), int(r[0])
            v, r = known[pair]
            if v >= 0:
                heapq.heappush(heap, (r, i, v, *pair))

        while heap:
            _, i, v, left, right = heapq.heappop(heap)
            j = after[i]
            if value[i] != left or j < 0 or value[j] != right:
                continue
            value[i], value[j], after[i] = v, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([v for v in value if v >= 0], np.int64)

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(b"".join(chunks).decode().encode("utf-32-le"), "<u4")
        symbols = self.symbol[points]
        lens = np.array([len(c.decode()) for c in chunks], np.int64)
        long = lens > LONG
        starts = np.cumsum(lens) - lens
        short, counts = self.merged(symbols[runs(starts[~long], lens[~long])], lens[~long]) if not long.all() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if long.any():
            parts = {i: self.merged_long(symbols[starts[i] : starts[i] + lens[i]]) for i in np.flatnonzero(long).tolist()}
            all_counts = np.zeros(len(lens), np.int64)
            all_counts[~long] = counts
            all_counts[list(parts)] = [len(p) for p in parts.values()]
            merged = np.zeros(int(all_counts.sum()), np.int64)
            at = np.cumsum(all_counts) - all_counts
            merged[runs(at[~long], counts)] = short
            for i, p in parts.items():
                merged[at[i] : at[i] + len(p)] = p
            short, counts = merged, all_counts
        return self.with_bytes(short, counts)

    def with_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: a character outside the vocabulary becomes the ids of its bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols.astype(np.int32), counts
        raw = [chr(c).encode() for c in (symbols[odd] - self.size).tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(r) for r in raw]
        out = np.repeat(symbols, width)
        at = np.cumsum(width) - width
        out[runs(at[odd], width[odd])] = self.bytes_[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.int32), sums(width, counts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        raw = [t.encode() for t in texts]
        body, lens = with_space(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64))
        ids, counts = self.chunks.of(coded(body, lens))
        return np.split(ids, np.cumsum(counts)[:-1])

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each sequence of ids in a row, as the library decodes it, and the lengths.

        Control ids have no text, and one space in front goes. Where bytes are no whole characters, where the unknown
        id occurs, or where a sequence does not begin with a space, the library itself decodes.
        """
        body, lens = gathered(self.table, self.starts, self.lens, ids), sums(self.lens[ids], counts)
        ends = np.cumsum(counts)
        first, strange = ends - counts, sums(self.special[ids].astype(np.int64), counts) > 0
        some = counts > 0
        plain = np.zeros(len(counts), bool)
        plain[some] = self.spaced[ids[first[some]]]
        at = np.cumsum(lens) - lens
        library: dict[int, bytes] = {}
        for i in np.flatnonzero((strange | ~plain) & (lens + strange > 0)).tolist():
            own = body[at[i] : at[i] + lens[i]].tobytes()
            try:
                good = plain[i] and bool(own.decode()) and 0 not in ids[first[i] : ends[i]]
            except UnicodeDecodeError:
                good = False
            if not good:
                library[i] = self.library.decode(ids[first[i] : ends[i]].tolist()).encode()
        cut = (lens > 0) & plain
        if not library:
            return body[runs(at + cut, lens - cut)], lens - cut
        parts = [library[i] if i in library else body[b + c : b + n].tobytes() for i, (b, n, c) in enumerate(zip(at.tolist(), lens.tolist(), cut.tolist(), strict=True))]
        return np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The model, loaded once by a worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def texts_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))


def encode_decode(docs: DataFrame, model_path: str, end: bool = True, keep_ids: bool = True, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, unless ``keep_ids`` is false, ids and decoded.

    ``ids`` are the library's, with its end id last if ``end``; ``ids_sha256`` is that of the decimal ids joined by
    spaces, ``decoded_sha256`` that of the decoded text. A null text counts as empty; the decoded text is then empty.
    Rows with the same id or text are encoded apart. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_path)
        for id_, data, lens in blocks(batches):
            ids, counts = model.chunks.of(coded(*with_space(data, lens)))
            if end:
                at = np.cumsum(counts)
                ids, counts = np.insert(ids, at, model.library.eos_id()), counts + 1
            shown, shown_lens = model.decimals.write(ids, np.uint8(32))
            decoded, decoded_lens = model.decoded(ids, counts)
            cols = [id_, pa.array(counts), pa.array(sha256_each(shown, sums(shown_lens, counts), drop=1), pa.string()), pa.array(sha256_each(decoded, decoded_lens), pa.string())]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())))
                offsets = np.concatenate([[0], np.cumsum(decoded_lens)]).astype(np.int32)
                cols.append(pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(decoded))]))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    ddl = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    names = [c.split()[0] for c in ddl.split(", ")]
    return texts_of(docs, id_col, text).mapInArrow(run, ddl)
