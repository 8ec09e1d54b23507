"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftlog.llm import exact_dedup, language_id, mixing, packing, quality_crf, quality_rules, repeats, sharding, simhash, toxicity
from weftlog.llm.common import held_out
from weftlog.llm.queries import not_in_fold, tokenizer_path

LONG = "one two three four five six seven eight nine ten " * 4000
LINE = "this line has a good many words in it so that it is long enough to count as a unit of its own here"
ROWS = [
    (1, LINE, "en", "a"), (1, LINE, "en", "a"), (2, None, None, None), (None, "no id at all", "de", None), (3, "", "en", "a"), (4, " \n\t", "en", "b"),
    (5, LONG, "fr", "b"), (6, "Ünï cödé \U0001f600 字", None, "b"), (7, f"{LINE}\nand more", "en", "a"), (8, LINE, "en", "a"), (9, "1 2 3", "en", "c"),
]
#: Names that the operators use inside or add.
CLASH = ("shard", "slot", "size", "target", "copies", "score", "n", "key", "digest", "doc", "id", "component", "best", "host", "lines", "removed", "left_share", "print")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").repartition(3)
    return base.withColumns({c: F.lit("mine") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id = -1")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 1, None), (8, None, 0), (9, 0, 1), (None, 1, 1), (9, 0, 1)], "doc_id bigint, quality int, toxic int")


def test_sharding(docs, empty):
    got = sharding.interleave(docs, 4).select("doc_id", "shard", "slot", "n").collect()
    assert len(got) == len(ROWS) and {r["n"] for r in got} == {"mine"}
    slots = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert sharding.interleave(empty, 4).count() == 0


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    line = [r for r in got if r["group_size"] == 3]
    assert {r["keep_id"] for r in line} == {8} and sum(r["kept"] for r in line) == 1
    assert sorted(r["id"] for r in got if r["group_size"] == 2) == [2, 3]  # null is empty
    kept = exact_dedup.keep_one(docs)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9] and set(CLASH) < set(kept.columns)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def test_exact_dedup_of_repeated_rows(docs):
    once = exact_dedup.keep_one(docs.filter("doc_id = 1"))
    assert [r["doc_id"] for r in once.collect()] == [1]


def test_packing(docs, empty):
    got = packing.pack(docs, tokenizer_path()).collect()
    assert {r["doc"] for r in got} == {r[0] for r in ROWS}
    assert {r["doc"]: r["doc_tokens"] for r in got}[2] == 1
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_quality(docs, empty, labels):
    model = quality_crf.train(docs, labels, not_in_fold(5, 0))
    got = quality_crf.score(docs, model)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows) and {r["key"] for r in rows} == {"mine"}
    assert quality_crf.score(empty, model).count() == 0
    untrained = quality_crf.train(docs, labels.filter("quality = 7"), not_in_fold(5, 0))
    assert {r["score"] for r in quality_crf.score(docs, untrained).collect()} == {0.5}


def test_simhash(docs, empty):
    got = {(r["doc"], r["component"]) for r in simhash.near_groups(docs).collect()}
    assert {(1, 1), (8, 1), (2, 2), (3, 2), (4, 2)} <= got and simhash.near_groups(docs).count() == len(ROWS)
    kept = simhash.keep_dissimilar(docs)  # 7 shares 18 of 20 shingles with 1
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 9] and set(CLASH) < set(kept.columns)
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_first(empty).count() == 0 and simhash.keep_dissimilar(empty).count() == 0


@pytest.mark.parametrize("keep", [simhash.keep_first, simhash.keep_dissimilar])
def test_near_copies_of_shared_and_null_ids(spark, keep):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (5, texts[2]), (None, texts[3])]
    kept = keep(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in kept) == [(0, "a"), (0, "b"), (5, "c"), (7, "d")]


def test_repeats(docs, empty):
    removed = repeats.repeated_units(docs)
    got = sorted((r["doc"], r["start"], r["end"], r["keep_doc"]) for r in removed.collect())
    assert got == [(7, 0, len(LINE), 1), (8, 0, len(LINE), 1)]
    cleaned = {r["doc_id"]: (r["text"], len(r["removed"])) for r in repeats.without_repeats(docs, removed).collect()}
    assert cleaned[1] == (LINE, 0) and cleaned[7] == ("\nand more", 1) and cleaned[2] == (None, 0)
    assert repeats.repeated_units(empty).count() == 0 and repeats.without_repeats(empty, removed).count() == 0


@pytest.mark.parametrize(("unit", "spans"), [("paragraph", [(0, 12)]), ("line", [(0, 5), (6, 12), (15, 20)]), ("clause", [(0, 5), (6, 10), (11, 12), (15, 20)])])
def test_units_of_each_kind(spark, unit, spans):
    docs = spark.createDataFrame([(1, "one 1\n two, 2\n\n \nlast"), (2, "ONE 1\ntwo, 2\n\n\none 1"), (None, "two,2")], "doc_id bigint, text string")
    got = repeats.repeated_units(docs, unit).collect()
    assert sorted((r["start"], r["end"]) for r in got) == spans and {(r["doc"], r["keep_doc"]) for r in got} == {(2, 1)}


def test_passages_overlap_and_keep_one(spark):
    """A text that repeats itself loses all but its first unit; its first passage needs two units."""
    docs = spark.createDataFrame([(1, "la la. la la. la la. la la. end of it"), (2, "la la. la la.")], "doc_id bigint, text string")
    removed = repeats.repeated_units(docs, "clause", 4)
    assert sorted((r["doc"], r["start"], r["end"], r["keep_doc"], r["keep_start"]) for r in removed.collect()) == [(1, 7, 20, 1, 0), (1, 14, 27, 1, 0), (2, 0, 13, 1, 0)]
    left = {r["doc_id"]: (r["text"], [tuple(x) for x in r["removed"]]) for r in repeats.without_repeats(docs, removed).collect()}
    assert left == {1: ("la la.  end of it", [(7, 27)]), 2: ("", [(0, 13)])}


def test_quality_rules(docs, empty):
    got = quality_rules.judge(docs, line_docs=1, line_share=0.0).collect()
    assert len(got) == len(ROWS)
    by = {r["id"]: r for r in got}
    assert by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
    assert by[5]["n_repeat_words"] == by[5]["n_words"] == 40_000
    assert by[1]["depleted"] and by[1]["left_share"] == 0 and not by[7]["kept"]  # two distinct texts of a host share the line
    cut = {r["doc_id"]: r["text"] for r in quality_rules.without_frequent_lines(docs, line_docs=1, line_share=0.0).collect()}
    assert cut[7] == "and more" and cut[2] is None
    assert quality_rules.judge(empty).count() == 0


def test_mixing(docs, empty):
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(ROWS) and all(0 <= r["copies"] <= 2 for r in mixed)
    assert {r["doc_id"]: r["size"] for r in mixed}[2] == 0
    assert mixing.taken_rows(mixing.mix(docs)).count() == sum(r["copies"] for r in mixed)
    assert mixing.mix(empty).count() == 0


def test_language(docs, empty):
    profiles = language_id.train(docs)
    got = language_id.identify(docs, profiles).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["id"]: r["lang_pred"] for r in got}
    assert {by[i] for i in (2, 3, 4, 9)} == {"und"} and by[1] == "en" and by[5] == "fr"
    assert language_id.identify(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}


def test_toxicity(docs, empty, labels):
    model = toxicity.train(docs, labels, not_in_fold(5, 0))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0


def test_held_out_of_null_is_false(docs):
    assert not docs.filter("doc_id is null").select(held_out("doc_id", 1, 0).alias("h")).first()["h"]


def test_pipeline_stages_on_edges(spark, docs, labels, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
    for rows, name in ((plain, "full"), (plain.filter("doc_id = -1"), "none")):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, f"{tmp_path}/full").columns)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
