"""Importance resampling, SentencePiece and tokenizer alignment against plain loops and the libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftlog.llm import alignment, flat, importance, pieces, queries

SF = "/root/testdata/sf0.001"

ODD = [
    None, "", " ", "  ", "\n", "a", "A  b ", " lead", "trail ", "x" * 50, "ab" * 3000, " " * 40 + "y", "▁ ▁x", "Ünïcödé 中文 🦦 naïve", "<s> </s> <|endoftext|> <0x0A>", "\x00\t\r\n\r\r z",
    "a b c　d \u0085e", "é ﬁ ‍", "12345 67,890.5", "same text", "same text", "it's we'll I'D don't", "==== " * 30, "Tab\tand\x0b\x0cfeeds", "word " * 700, "e" * 2100 + " tail", "esntr" * 90 + " " + "esntr" * 200,
]


def plain(path):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(queries.tokenizer_path(queries.PIECES))


def rough_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "ab", "the", "ing", " ", "  ", "\n", "\t", "é", "中", "🦦", "▁", "1", "000", "=", "==", "<s>", "\x00", "tion", "A", "’", "́", "\r", "　"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_pieces_equal_library(model):
    library = plain(queries.tokenizer_path(queries.PIECES))
    texts = [t or "" for t in ODD] + rough_texts(3000, 1) + ["".join(random.Random(2).choice("abcde") for _ in range(9000))]
    assert [e.tolist() for e in model.encode(texts)] == library.encode(texts)


def test_hasty_merges_equal_library(model):
    """Words of few letters, and of pieces that outrank their parts, whose merges meet at once in many places."""
    library, rng = plain(queries.tokenizer_path(queries.PIECES)), random.Random(9)
    hasty = [library.id_to_piece(int(i)).replace("▁", "") for i in np.flatnonzero(model.one_by_one[np.minimum(model.rank, len(model.one_by_one) - 1)])[:1500]]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 120))) for letters in ("ab", "aeiou", "th ean", "=-", " a", "0123", "esntr") for _ in range(300)]
    texts += ["".join(rng.choice(hasty) for _ in range(rng.randint(2, 30))) for _ in range(2000)] + [(x + y) * 9 for x, y in zip(hasty, hasty[1:], strict=False)]
    assert [e.tolist() for e in model.encode(texts)] == library.encode(texts)


def test_decoding_equals_library(model):
    library, rng = plain(queries.tokenizer_path(queries.PIECES)), random.Random(3)
    rows = [library.encode(t, add_eos=True) for t in rough_texts(500, 4)] + [[rng.randrange(rng.choice([260, 32000])) for _ in range(rng.randint(0, 9))] for _ in range(3000)]
    got, lens = model.decoded(np.array([i for r in rows for i in r]), np.array([len(r) for r in rows]))
    ends = np.cumsum(lens)
    assert [got[b:e].tobytes().decode() for b, e in zip(ends - lens, ends, strict=True)] == [library.decode(r) for r in rows]


def test_remembered_chunks_are_forgotten(model):
    small = flat.Remembered(model.encode_chunks, limit=5)
    for text in ("one two three", "one four five six seven eight nine", "two one"):
        raw = text.encode()
        ids, _ = small.of(flat.coded(*flat.with_space(np.frombuffer(raw, np.uint8), np.array([len(raw)]))))
        assert ids.tolist() == model.library.encode(text)


def odd_docs(spark):
    rows = [(i, t, f"c{i}", i) for i, t in enumerate(ODD)] + [(None, "no id", None, 0), (3, "id again", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_words int").repartition(3)


def test_sentencepiece_query_equals_library(spark):
    library = plain(queries.tokenizer_path(queries.PIECES))
    for docs in (queries.documents(spark, SF), odd_docs(spark)):
        want = []
        for r in docs.collect():
            ids = library.encode(r["text"] or "", add_eos=True)
            want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids, library.decode(ids)))
        got = pieces.encode_decode(docs, queries.tokenizer_path(queries.PIECES)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert pieces.encode_decode(docs.limit(0), queries.tokenizer_path(queries.PIECES)).count() == 0


def naive_alignment(docs):
    """Two pointers and dictionaries, document by document."""
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_LEVEL)), plain(queries.tokenizer_path(queries.PIECES))
    a_tok.encode_special_tokens = True
    level = alignment.ByteLevel(queries.tokenizer_path(queries.BYTE_LEVEL))
    bytes_of = lambda i: level.table[level.starts[i] : level.starts[i] + level.lens[i]].tobytes()
    rows = []
    for doc, text in docs:
        whole, links, groups = (" " + (text or "")).encode(), [], []
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        a_bytes = [bytes_of(i) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_tok.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b = [], []
        i = j = at_a = at_b = 0
        left, right = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                at_a += len(a_bytes[i])
                left.append(a[i])
                i += 1
            else:
                at_b += len(b_bytes[j])
                right.append(b[j])
                j += 1
            if at_a == at_b:
                groups.append((left, right))
                links += [(x, y) for x in left for y in right]
                left, right = [], []
        rows.append((doc, len(a), len(b), groups, links))
    count = Counter(p for *_, links in rows for p in set(links))
    best_a, best_b = defaultdict(int), defaultdict(int)
    for (x, y), n in count.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    out = []
    for doc, n_a, n_b, groups, links in rows:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(count[p] == best_a[p[0]] for p in links), sum(count[p] == best_b[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_two_pointers(spark, small, monkeypatch):
    """With small limits, lists of pairs, turns and crowded groups are many."""
    paths = queries.tokenizer_path(queries.BYTE_LEVEL), queries.tokenizer_path(queries.PIECES)
    docs = odd_docs(spark) if small else queries.documents(spark, SF)
    want = naive_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = alignment.align(docs, *paths).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert alignment.align(docs.limit(0), *paths).count() == 0
    if small:
        monkeypatch.setattr(alignment, "CROWDED", 2)
        monkeypatch.setattr(alignment, "EXPANDED", 7)
        aligner = alignment.Aligner(*paths)
        for doc, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
            raw = (text or "").encode()
            aligner.add(__import__("pyarrow").array([doc]), np.frombuffer(raw, np.uint8), np.array([len(raw)]))
        tables = list(aligner.pack(0))
        listed = tables[0].column("pairs").to_pylist()[0]
        open_ = alignment.zstandard.ZstdDecompressor().decompress
        total = 0
        for raw, n in zip(tables[1].column("links").to_pylist(), tables[1].column("n_links").to_pylist(), strict=True):
            at, times = alignment.unpacked(open_(raw)) if raw else ([], [])
            assert sum(times) == n
            total += len(at)
        assert total == sum(p["docs"] for p in listed)


def test_pair_counts_equal_loops(spark):
    paths = queries.tokenizer_path(queries.BYTE_LEVEL), queries.tokenizer_path(queries.PIECES)
    docs = spark.createDataFrame([(1, "the the cat"), (2, "the dog"), (3, None)], "doc_id long, text string")
    got = alignment.pair_counts(alignment.lists(alignment.aligned(docs, *paths))).collect()
    assert max(r["docs"] for r in got) == 2 and all(r["docs"] <= min(r["best_a"], r["best_b"]) for r in got)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def naive_resample(docs, target, percent, min_words):
    def grams(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = (Counter(bucket(g) for text in texts for g in grams(text)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows, wide = [], []
    for doc, text in docs:
        n, found = grams(text)
        weight = sum(gain[bucket(g)] for g in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, n, len(found), weight, score, None])
        if n >= min_words:
            wide.append(rows[-1])
    wide.sort(key=lambda r: (-r[4], r[0] is not None, r[0]))
    for i, r in enumerate(wide[: len(wide) * percent // 100]):
        r[5] = i + 1
    return [tuple(r) for r in rows]


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (100, 0), (50, 2), (0, 0)])
def test_resampling_equals_loops(spark, percent, least):
    docs, target = odd_docs(spark), spark.createDataFrame([("the same text",), (None,), ("word word word",)], "text string")
    if percent == 5:
        docs, target = queries.documents(spark, SF), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = naive_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], percent, least)
    got = importance.resample(docs, target, percent=percent, min_words=least).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_resampling_of_nothing(spark):
    docs, target = odd_docs(spark), spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target).count() == docs.count()


def test_buckets_of_slices_and_wide_vocabularies(monkeypatch):
    """Positions sorted a few at a time, and keys too wide for one number, give the same buckets."""
    raw = [(t or "").encode() for t in ODD + rough_texts(50, 5)]
    data, lens = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
    whole, counts = importance.Grams().of(data, lens)
    monkeypatch.setattr(importance, "SORTED", 7)
    some, _ = importance.Grams().of(data, lens)
    assert np.array_equal(whole, some)
    longer, _ = importance.Grams(longest=40).of(data, lens)  # beyond 62 bits
    assert np.array_equal(longer[:3], whole) and counts.sum() == whole.shape[1]
    w = WORD.findall(b"".join(raw[6:7]).decode().lower())
    at = int(counts[:6].sum())
    assert whole[1, at] == zlib.crc32(" ".join(w[:2]).encode()) % 10000
