"""Limits set small, so that rounds, hot keys, salts and slices are many; and scores against naive paths, one text at a time."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlog.llm import common, exact_dedup, mixing, packing, quality_crf, quality_rules, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"


def test_rounds_of_exact_dedup(spark, monkeypatch):
    """Many runs, slices and rounds; one text has most of the rows."""
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    monkeypatch.setattr(exact_dedup, "RUN_ENTRIES", 7)
    monkeypatch.setattr(exact_dedup, "SLICE_ENTRIES", 40)
    monkeypatch.setattr(common, "HOT_LEAST", 5)
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.6 else f"t{rng.randint(0, 90)}") for i in range(700)]
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(13), keep=keep).collect()
        ids = {}
        for i, t in rows:
            ids.setdefault(t, []).append(i)
        assert {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(i, best(ids[t]), len(ids[t]), i == best(ids[t])) for i, t in rows}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_of_hot_keys(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", "warm", f"k{i % 50}", None])) for i in range(500)]
    left = spark.createDataFrame(rows, "i int, k string").repartition(6)
    side = left.filter("k is not null and k != 'k7'").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    got = common.join_hot(left, side, "k", "n", len(rows), F.xxhash64("i"), how)
    plain = left.join(side, "k", how)
    key = lambda d: sorted(map(str, d.select("i", "k", "n", "least").collect()))
    assert key(got) == key(plain)


def test_mix_with_salted_sources(spark, monkeypatch):
    docs = queries.documents(spark, SF)
    cols = ["doc_id", "size", "source_size", "target", "copies"]
    want = sorted(map(str, mixing.mix(docs).select(*cols).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, mixing.mix(docs).select(*cols).collect())) == want


def test_targets_of_many_words(spark):
    """Products of words and weights beyond 64 bits."""
    sizes = spark.createDataFrame([(f"a{i:03}", 10**15 + i) for i in range(300)], "`__s` string, source_size bigint")
    rows = mixing.targets(sizes, (3, 1, 2), (3, 2), 2).collect()
    total = sum(r["target"] for r in rows)
    assert abs(total - 1.5 * sum(r["source_size"] for r in rows)) <= 1e-9 * total and all(0 < r["target"] <= 2 * r["source_size"] for r in rows)


def test_shards_are_written(spark, tmp_path):
    docs = queries.documents(spark, SF)
    placed = sharding.interleave(docs.select("doc_id", "source"), 5)
    sharding.write_shards(placed, f"{tmp_path}/shards")
    read = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(str, read.select("doc_id", "shard", "slot").collect())) == sorted(map(str, placed.select("doc_id", "shard", "slot").collect()))
    one = [r["slot"] for r in spark.read.parquet(f"{tmp_path}/shards/shard=3").collect()]
    assert one == sorted(one)


def test_lines_of_nothing(spark):
    docs = queries.documents(spark, SF)
    assert quality_rules.without_frequent_lines(docs.limit(0)).count() == 0


def test_ids_of_another_tokenizer():
    """A tokenizer that splits in another way is used whole, with its own ids."""
    texts = ["It's 12ab  x", "", None, " the the\n\nEND <|endoftext|> ñ"]
    for name, split in ((queries.BYTE_LEVEL, False), (queries.TOKENIZER, True)):
        ids = packing.Ids(queries.tokenizer_path(name))
        assert ids.split == split
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.of(texts)] == [ids.whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def naive_quality(model, text):
    """Line by line: potentials, forward and backward in logarithms, and the mean by length."""
    x, lengths = quality_crf.features(text)
    own = ((x - model["mean"]) / model["scale"]) @ model["w"]
    emit, move, n = [[0.0, float(v)] for v in own], model["trans"], len(own)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    fwd, bwd = [emit[0]], [[0.0, 0.0]]
    for t in range(1, n):
        fwd.append([add(fwd[-1][0] + move[0][y], fwd[-1][1] + move[1][y]) + emit[t][y] for y in (0, 1)])
    for t in range(n - 1, 0, -1):
        bwd.append([add(*[move[y][z] + emit[t][z] + bwd[-1][z] for z in (0, 1)]) for y in (0, 1)])
    bwd.reverse()
    good = [1 / (1 + math.exp(fwd[t][0] + bwd[t][0] - fwd[t][1] - bwd[t][1])) for t in range(n)]
    q = min(1 - 1e-4, max(1e-4, sum(g * k for g, k in zip(good, lengths, strict=True)) / sum(lengths)))
    return 1 / (1 + math.exp(-(model["a"] * math.log(q / (1 - q)) + model["b"])))


def naive_toxicity(model, text):
    """Two compressions of every eight words, their differences summed up, and a dot product."""
    plain, toxic = toxicity.compressor(model["plain"]), toxicity.compressor(model["toxic"] + model["plain"])
    words = (text or "").lower().split()  # of the small table's texts, which have ASCII white space only
    saved = []
    for i in range(0, len(words), 8):
        raw = f" {' '.join(words[i : i + 8])} ".encode()
        saved.append(len(plain.compress(raw)) - len(toxic.compress(raw)))
    saved = saved or [0]
    v = [sum(saved) / len(saved), math.log1p(max(0, *saved, 0)), sum(max(0, s - 1) for s in saved) / len(saved), math.log1p(len(saved))]
    z = sum((a - m) / s * w for a, m, s, w in zip(v, model["mean"], model["sd"], model["w"], strict=False)) + model["w"][-1]
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize(("name", "train", "naive"), [("op4_quality_crf", quality_crf.train, naive_quality), ("op10_compression_toxicity", toxicity.train, naive_toxicity)])
def test_scores_equal_naive_paths(spark, name, train, naive):
    docs = queries.documents(spark, SF)
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"), queries.not_in_fold(5, 0))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.queries()[name](spark, SF).collect()
    assert len(rows) == len(texts) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(abs(r["score"] - naive(model, texts[r["doc_id"]])) < 1e-6 for r in rows)


def test_quality_keeps_named_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, None, 6)], "doc_id bigint, text string, score int")
    model = {"constant": 0.25}
    assert quality_crf.score(docs, model, keep=["doc_id"]).collect() == [(1, 0.25), (2, 0.25)]
    assert [tuple(r) for r in quality_crf.score(docs, model).orderBy("doc_id").collect()] == [(1, "a b c", 0.25), (2, None, 0.25)]
