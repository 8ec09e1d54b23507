"""What is cut in two levels against one level: sessions over spans, running totals over ranges, k-th distances without a product."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftlog.operators import boundary, mining, ranges, sessions
from weftlog.sources import writers


def test_sessions_over_spans(spark):
    """Gaps within spans, at their edges and over empty ones; ties, one client with nearly all events, null keys and times."""
    rng = random.Random(5)
    rows, t = [], 0.0
    for i in range(600):
        t += rng.choice([0, 1, 9, 10, 10.5, 11, 25, 300])
        rows.append((rng.choice(["p", "p", "p", "p", "q", None]), t if rng.random() > 0.02 else None, i))
    df = spark.createDataFrame(rows, "c string, t double, id int").repartition(5)
    key = lambda d: sorted((r["id"], r["segment"]) for r in d.collect())
    for span in (7.0, 50.0, 1e9):
        assert key(sessions.by_gap_wide(df, ["c"], "t", ["id"], 10, span)) == key(sessions.by_gap(df, ["c"], "t", ["id"], 10))
    assert sessions.by_gap_wide(df.limit(0), ["c"], "t", ["id"]).count() == 0


def test_totals_over_ranges(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.randint(0, 20), rng.randint(-3, 9)) for i in range(500)], "id int, k int, v int").repartition(7)
    order = [F.desc("k"), F.asc("id")]
    want = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = lambda d: sorted(map(tuple, d.select("id", "x").collect()))
    assert plain(ranges.before(df, order, "x")) == plain(df.withColumn("x", F.row_number().over(Window.orderBy(*order)) - 1))
    assert plain(ranges.before(df, order, "x", "v")) == plain(df.withColumn("x", F.coalesce(F.sum("v").over(want), F.lit(0))))
    assert ranges.before(df.limit(0), order, "x").count() == 0


def test_kth_distances_of_strangers(spark):
    """Sequences that share no call with any other, or with too few: all distances by the length feature alone, none left out."""
    traces = {"a": ["x"], "b": ["y"] * 9, "c": ["z"], "d": ["x", "q"], "e": ["w"] * 3, "f": ["v", "u"], "g": ["y"] * 2}
    steps = spark.createDataFrame([(s, i, a) for s, apis in traces.items() for i, a in enumerate(apis, 1)], "session_id string, step int, api string")
    distinct, _ = mining.sequences(steps)
    vector = mining.vectors(distinct)
    norm = mining.norms(distinct, vector)
    names = {r["seq"]: r["first"] for r in distinct.collect()}
    values, length = {}, {r["seq"]: r for r in norm.collect()}
    for r in vector.collect():
        values.setdefault(r["seq"], {})[r["feature"]] = r["v"]

    def away(a, b):
        dot = sum(v * values[b].get(f, 0) for f, v in values[a].items()) + length[a]["len"] * length[b]["len"]
        return 1 - dot / (length[a]["norm"] * length[b]["norm"])

    for least in (2, 3, 4, 6, 20):
        pairs = mining.close_pairs(vector, norm, 0.2)
        got = {names[r["seq"]]: r["k_dist"] for r in mining.kth_distances(distinct, pairs, vector, norm, least, len(traces)).collect()}
        k = max(1, min(least - 1, len(traces) - 1))
        want = {names[a]: sorted(max(0.0, away(a, b)) for b in names if b != a)[k - 1] for a in names}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_new_partitions_only(spark, tmp_path):
    """Two runs equal one; a run lost before its note is replaced; a partition without a value counts as one."""
    path, done = f"{tmp_path}/t", f"{tmp_path}/done"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, p string")
    read = lambda: sorted((r["n"], r["p"]) for r in spark.read.schema("n int, p string").parquet(path).collect())
    writers.refresh(df.withColumn("n", F.col("n") + 10), path, "p")  # never noted
    for _ in range(2):
        writers.refresh_new(df, path, done, "p")
        assert read() == [(1, "a"), (2, "b"), (3, None)]
    writers.refresh_new(spark.createDataFrame([(9, "a"), (4, "c")], "n int, p string"), path, done, "p")
    assert read() == [(1, "a"), (2, "b"), (3, None), (4, "c")]


def test_widest_of_ties_and_nothing(spark):
    rel = spark.createDataFrame([("p", "i1", 2), ("p", "i2", 2), ("q", "i1", 9), ("r", "i9", 1)], "project string, issue string, n bigint")
    got = boundary.widest(rel, "project", "issue", min_support=2, top_items=1, limit=0).collect()
    assert sorted((r["project"], r["support"], r["issue_count"], [tuple(x) for x in r["issues"]]) for r in got) == [("p", 4, 2, [("i1", 2)]), ("q", 9, 1, [("i1", 9)])]
    assert boundary.widest(rel.limit(0), "project", "issue").count() == 0
