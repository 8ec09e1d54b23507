"""Operators against brute force, exact round trips and held-out labels; queries with SQL against DuckDB."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from weftlog.llm import language_id, mixing, packing, queries, quality_crf, simhash, toxicity
from weftlog.llm.exact_dedup import exact_groups

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    want = con.sql(queries.oracle_sql()[name]).to_arrow_table()
    got = queries.queries()[name](spark, SF).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)

    def plain(table):
        return sorted(tuple(map(str, r)) for r in zip(*(table[c].to_pylist() for c in sorted(table.column_names)), strict=True))

    assert plain(got) == plain(want)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    docs = {r["doc_id"]: r["text"] for r in queries.documents(spark, SF).collect()}
    rows = queries.op3_tier_packing(spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == docs.keys()
    for doc, text in docs.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, packing.END]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    pad = 0
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad <= 0.02 * sum(r["length"] for r in rows)
    tiers = Counter((r["step_group"], r["tier"]) for r in rows if r["offset"] == 0)
    for tier in {t for _, t in tiers}:
        each = [tiers[g, tier] for g in range(1 + max(g for g, _ in tiers))]
        assert max(each) - min(each) <= 1


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    pos = np.array(labels) == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum())


#: Toxic texts are rare: sf0.01 trains on few of them and holds out 6; sf0.1 holds out 97.
@pytest.mark.parametrize(("name", "label", "least", "sf"), [("op4_quality_crf", "quality", 0.9, SF2), ("op10_compression_toxicity", "toxic", 0.6, SF2), ("op10_compression_toxicity", "toxic", 0.85, "/root/testdata/sf0.1")])
def test_held_out_labels(spark, name, label, least, sf):
    marks = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.queries()[name](spark, sf).collect() if r["held_out"] and marks.get(r["doc_id"]) is not None]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert auc([r["score"] for r in rows], [marks[r["doc_id"]] for r in rows]) >= least


def test_language_of_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in queries.documents(spark, SF2).collect()}
    rows = [r for r in queries.op9_rank_order_language(spark, SF2).collect() if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.9 * len(rows)


def naive_grams(text):
    """1 to 3 letters of the words of a text, padded by a space; grams of spaces only do not count."""
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    found = Counter(c for c in padded if c != " ")
    found.update(padded[i : i + 2] for i in range(len(padded) - 1) if padded[i : i + 2] != "  ")
    found.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return found


def naive_profile(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][: language_id.PROFILE]


def test_language_equals_brute_force(spark):
    """Out-of-place distances of naive profiles; every learned document of the small table counts."""
    docs = queries.documents(spark, SF).collect()
    learned = defaultdict(Counter)
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            learned[r["lang"]].update(naive_grams(r["text"]))
    profiles = {lang: {g: i for i, g in enumerate(naive_profile(c))} for lang, c in learned.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op9_rank_order_language(spark, SF).collect()}
    for r in docs:
        own = naive_profile(naive_grams(r["text"] or ""))
        away = sorted((sum(abs(p[g] - i) if g in p else language_id.PROFILE for i, g in enumerate(own)), lang) for lang, p in profiles.items())
        want = (away[0][1], 1 - away[0][0] / away[1][0]) if own else ("und", 0.0)
        assert got[r["doc_id"]] == (want[0], pytest.approx(want[1]))


def test_language_sample_is_bounded(spark):
    rows = [(i, "de" if i % 3 else "fr", f"wort{i % 7} satz") for i in range(6000)] + [(None, "de", "ohne nummer")] * 3000
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    profiles = language_id.train(docs, per_lang=50)
    assert set(profiles) == {"de", "fr"} and ord("h") not in profiles["de"]


def test_window_distances():
    """The bytes that the toxic dictionary saves, by two compressions of each eight words; texts in any case."""
    import zstandard

    plain, toxic = b" and then the river went on to the sea ", b" gnarlwort "
    text = "And then the GNARLWORT went on to the sea gnarlwort of the river and then on"
    words = text.lower().split()
    how = {raw: zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=64, dict_size=len(raw), min_match=toxicity.MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0) for raw in (plain, toxic + plain)}

    def size(raw, some):
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(compression_params=how[raw], dict_data=held).compress((" " + " ".join(some) + " ").encode()))

    saved = [size(plain, words[i : i + 8]) - size(toxic + plain, words[i : i + 8]) for i in range(0, len(words), 8)]
    got = toxicity.distances(toxicity.compressor(plain), toxicity.compressor(toxic + plain), text)
    assert got.tolist() == pytest.approx([np.mean(saved), math.log1p(max(saved)), np.maximum(np.array(saved) - 1, 0).mean(), math.log1p(len(saved))]) and max(saved) > 2


def reference_fingerprint(text, size):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.documents(spark, SF).collect()}
    prints = {d: reference_fingerprint(t, 3) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_groups(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in docs}


def test_large_shards_are_cut_and_still_meet(spark, monkeypatch):
    """Fingerprints that share nearly all bits are in one shard; with slices of 50 nodes the components stay the same."""
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(20), 6)) for _ in range(400)}
    nodes = spark.createDataFrame([(p,) for p in prints], "print bigint")
    whole = {(r["node"], r["root"]) for r in simhash.components(simhash.links(nodes, len(prints), 3)).collect()}
    monkeypatch.setattr(simhash, "TASK_NODES", 50)
    cut = {(r["node"], r["root"]) for r in simhash.components(simhash.links(nodes, len(prints), 3)).collect()}
    assert cut == whole and len(whole) > 100


@pytest.mark.parametrize("words", [1, 8])
def test_stars_connect_what_brute_force_connects(words):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, (1, words)).astype(np.uint64)
    dense = np.repeat(centre, 700, axis=0)
    for _ in range(words):  # a dense group, and strangers
        dense[np.arange(700), rng.integers(0, words, 700)] ^= np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)
    value = np.unique(np.vstack([dense, rng.integers(0, 2**63, (60, words)).astype(np.uint64)]), axis=0)
    key, radius = np.zeros(len(value), np.int64), 3 * words
    a, b = simhash.stars(key, value, radius)
    near = np.array([[int(np.bitwise_count(x ^ y).sum()) <= radius for y in value] for x in value])
    left, components = set(range(len(value))), 0
    while left:
        stack, components = [left.pop()], components + 1
        while stack:
            found = left & set(np.flatnonzero(near[stack.pop()]))
            left -= found
            stack += found
    assert len(value) - len({tuple(x) for x in a}) == components
    assert len(a) == len({tuple(x) for x in a})


def test_similar_groups(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, near = [], {}
    for base in range(40):
        text = [rng.choice(vocabulary) for _ in range(400)]
        rows.append((10 * base, " ".join(text)))
        for k in range(1, 4):
            edited = list(text)
            for _ in range(2 * k):  # 2 to 6 words of 400: a similarity of 0.86 or more
                edited[rng.randrange(400)] = rng.choice(vocabulary)
            rows.append((10 * base + k, " ".join(edited)))
            near[10 * base + k] = 10 * base
        rows.append((10 * base + 9, " ".join([*text[:200], *(rng.choice(vocabulary) for _ in range(200))])))  # a third
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc"]: r["component"] for r in simhash.similar_groups(docs).collect()}
    assert all(got[10 * b + 9] == 10 * b + 9 for b in range(40))
    assert sum(got[d] == b for d, b in near.items()) >= 0.97 * len(near)


def jaccard(a, b, size=5):
    x, y = (set(zip(*(t.split()[k:] for k in range(size)), strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("slices", [500_000, 5_000])
def test_similar_groups_equal_exact_jaccard(spark, monkeypatch, slices):
    """Pairs between 0.7 and 0.9, and a chain of edits that is one candidate group of several slices."""
    monkeypatch.setattr(simhash, "SLICE", slices)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for i in range(150):
        base = [word() for _ in range(200)]
        edited = list(base)
        for at in rng.sample(range(5, 195), 2 + i % 6):
            edited[at] = word()
        texts += [" ".join(base), " ".join(edited)]
    chain = [word() for _ in range(200)]
    for i in range(60):
        texts.append(" ".join(chain))
        for at in rng.sample(range(5, 195), 3 + i % 3):
            chain[at] = word()
    want, near = list(range(len(texts))), 0
    for b in range(len(texts)):
        for a in range(b - 1 if b < 300 and b % 2 else 300 if b >= 300 else b, b):
            if (j := jaccard(texts[a], texts[b])) >= 0.8:
                want = [want[a] if w == want[b] else w for w in want] if want[a] < want[b] else [want[b] if w == want[a] else w for w in want]
            near += 0.7 < j < 0.9
    assert near > 60
    got = {r["doc"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert all(want[d] == want[c] for d, c in got.items())  # never a link below 0.8
    assert sum(got[d] == want[d] for d in got) >= 0.98 * len(got)


def exact_survivors(texts):
    """The smallest id of each group linked at a Jaccard similarity of 0.8 of five-word shingles."""
    sets = {d: set(simhash.shingles(t, 5).tolist()) for d, t in texts.items()}
    root = {}
    for i in sorted(sets):
        joined = {root[j] for j in root if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        root = {k: min([i, *joined]) if v in joined else v for k, v in root.items()} | {i: min([i, *joined])}
    return sorted(set(root.values()))


def test_near_stage_keeps_what_exact_jaccard_keeps(spark):
    texts = {}
    for r in queries.documents(spark, SF).collect():
        texts[r["text"] or ""] = max(r["doc_id"], texts.get(r["text"] or "", -1))
    texts = {d: t for t, d in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_dissimilar(docs).collect()) == exact_survivors(texts)


def test_repeated_passages_are_found(spark):
    """Of the words in 50-word windows that stand in an earlier document too, and of the documents that have one."""
    import re

    texts = {r["doc_id"]: r["text"] or "" for r in queries.documents(spark, SF2).collect()}
    places = {d: [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for d, t in texts.items()}
    seen, holders, repeated = {}, {}, {}
    for d in sorted(texts):
        words = [w for *_, w in places[d]]
        for i in range(len(words) - 49):
            if seen.setdefault(tuple(words[i : i + 50]), d) != d:
                repeated.setdefault(d, set()).update(range(i, i + 50))
        for i in range(len(words) - 11):
            holders.setdefault(tuple(words[i : i + 12]), set()).add(d)
    gone, other = {}, set()
    for r in queries.op6_repeated_lines(spark, SF2).collect():
        gone.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
        other |= {r["doc_id"]} if r["keep_doc_id"] != r["doc_id"] else set()
    covered = sum(any(a <= places[d][i][0] and places[d][i][1] <= b for a, b in gone.get(d, ())) for d, some in repeated.items() for i in some)
    assert covered >= 0.9 * sum(map(len, repeated.values())) > 0
    assert len(repeated.keys() & gone.keys()) >= 0.98 * len(repeated)
    shared = set().union(*(d for d in holders.values() if len(d) > 1))
    assert not other - shared  # others repeat but themselves
    print(f"covered {covered / sum(map(len, repeated.values())):.3f}, {len(other)} documents")


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert set(got[i] for i in range(1, 61)) == {1} and got[101] == got[100] == 100


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    x, w, trans = rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=(2, 2))
    p, _ = quality_crf.Chains([x]).marginals(w, trans)
    total, good = 0.0, np.zeros(5)
    for m in range(32):
        y = [m >> i & 1 for i in range(5)]
        e = math.exp(sum(s for s, v in zip(x @ w, y, strict=True) if v) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        total, good = total + e, good + e * np.array(y)
    assert np.allclose(p, good / total)


def test_mix_is_near_targets(spark):
    rows = mixing.mix(queries.documents(spark, SF2)).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_pipeline_equals_brute_force(spark):
    """Stage by stage, each on what its predecessor kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = queries.documents(spark, SF)
    scored = {r["doc_id"]: r["predicted"] for r in queries.op4_quality_crf(spark, SF).collect()}
    good = stages["quality classifier"](spark, docs, SF)
    assert {r["doc_id"] for r in good.collect()} == {d for d, v in scored.items() if v}
    texts = defaultdict(list)
    for r in good.collect():
        texts[r["text"] or ""].append(r["doc_id"])
    once = stages["exact dedup"](spark, good, SF)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(max(v) for v in texts.values())
    apart = stages["SimHash near-dedup"](spark, once, SF)
    assert sorted(r["doc_id"] for r in apart.collect()) == exact_survivors({r["doc_id"]: r["text"] for r in once.collect()})
    mixed = stages["mixing sources to target weights"](spark, apart, SF)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    packed = stages["packing"](spark, mixed, SF).collect()
    ends = Counter(r["doc_id"] for r in packed if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == copies


def test_exact_groups_keep_smallest(spark):
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "doc_id bigint, text string")
    got = {r["id"]: (r["keep_id"], r["kept"]) for r in exact_groups(docs, keep="smallest").collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_ids_equal_the_tokenizers():
    """Marks that join letters, letters that change when lowered, names of special tokens, contractions, odd white space."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole, ids, draw = Tokenizer.from_file(path), packing.Ids(path), random.Random(1)
    parts = [*"aAbIiJKsSTWHYyéÉßİıǅﬁΣς.,'!<|>01 \t\n\x1f 　̱̀̇̌̊ͅẞÅΩ", "<|endoftext|>", "<|ENDOFTEXT|>", "'S", "'LL", "it's"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(5000)]
    assert list(ids.of(texts)) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
