"""Behaviour of sessions: transitions, sparse vectors, cosine distances, density clusters, medoids.

Sessions with the same sequence have the same vector, so vectors, distances and clusters are of distinct
sequences weighted by how many sessions have them; that is where log data repeat most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.text import capped_log, clamp
from weftlog.operators import blocks
from weftlog.operators.graph import components, written
from weftlog.operators.ranges import before

#: Tasks that a cluster's sum of a feature is dealt to.
SALTS = 16
#: Distances this much above eps are within it: eps may be a distance itself, summed in another order.
SLACK = 1e-9


@dataclass(frozen=True)
class Weights:
    presence: float = 1.0
    frequency: float = 0.8
    direct: float = 1.4
    skip: float = 1.1
    length: float = 0.25
    endpoint: float = 0.8
    cap: int = 5
    max_skip: int = 5


def directly_follows(steps: DataFrame, session: list[str], api: str = "api") -> DataFrame:
    """Counts of (source, target) pairs one step apart."""
    w = Window.partitionBy(*session).orderBy("step")
    pairs = steps.select(F.col(api).alias("source"), F.lead(api).over(w).alias("target"))
    return pairs.filter("target is not null").groupBy("source", "target").agg(F.count("*").alias("n"))


def skip_pairs(steps: DataFrame, session: list[str], api: str = "api", max_skip: int = 5) -> DataFrame:
    """Pairs 2 to ``max_skip`` steps apart with their decayed weight 1 / (skipped steps + 1)."""
    w = Window.partitionBy(*session).orderBy("step")
    ahead = F.array(*[F.struct(F.lit(k).alias("distance"), F.lead(api, k).over(w).alias("target")) for k in range(2, max_skip + 1)])
    pairs = steps.withColumn("ahead", ahead).select(*session, F.col(api).alias("source"), F.explode("ahead").alias("p"))
    return pairs.select(*session, "source", "p.target", "p.distance").filter("target is not null").withColumn("weight", 1 / F.col("distance"))


def trace_summary(steps: DataFrame, session: list[str], api: str = "api", top: int = 8) -> DataFrame:
    """Per session: length, distinct activities, first, last, and the most frequent (ties: first seen)."""
    counts = steps.groupBy(*session, api).agg(F.count("*").alias("n"), F.min("step").alias("seen"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*session).orderBy(F.desc("n"), "seen"))).filter(F.col("r") <= top)
    frequent = ranked.groupBy(*session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", api, "n"))), lambda x: F.concat_ws(":", x[api], x["n"].cast("string"))), ",").alias("top_activities"))
    ends = steps.groupBy(*session).agg(F.count("*").alias("length"), F.min(F.struct("step", api))[api].alias("first_activity"), F.max(F.struct("step", api))[api].alias("last_activity"))
    distinct = counts.groupBy(*session).agg(F.count("*").alias("distinct_activities"))
    return ends.join(distinct, session).join(frequent, session)


def sequences(steps: DataFrame, session: str = "session_id", api: str = "api") -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (seq, first, n, length, apis) and each session's (session, seq); ``first`` is the smallest session."""
    lists = steps.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", api))), lambda x: x[api]).alias("apis"))
    lists = lists.withColumn("seq", F.sha2(F.array_join("apis", "\x1f"), 256))
    distinct = lists.groupBy("seq").agg(F.min(session).alias("first"), F.count("*").alias("n"), F.first("apis").alias("apis"))
    return written(distinct.withColumn("length", F.size("apis"))), written(lists.select(session, "seq"))


def vectors(distinct: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Long vectors (seq, feature, v): presence, capped frequency, direct pairs, decayed skip pairs, ends.

    The length feature, which every sequence has, is the dense column ``len`` of ``norms`` instead.
    """
    w = weights
    step = distinct.select("seq", F.posexplode("apis").alias("i", "api"), "apis")
    count = step.groupBy("seq", "api").agg(F.count("*").alias("c"))
    seen = count.select("seq", F.concat(F.lit("seen:"), "api").alias("feature"), F.lit(w.presence).alias("v"))
    often = count.select("seq", F.concat(F.lit("freq:"), "api").alias("feature"), (w.frequency * capped_log(F.col("c"), w.cap)).alias("v"))
    ahead = step.select("seq", "api", F.posexplode(F.slice("apis", F.col("i") + 2, F.lit(w.max_skip))).alias("k", "target"))
    pair = F.concat_ws("\x1f", "api", "target")
    direct = ahead.filter("k = 0").groupBy("seq", pair.alias("p")).agg(F.count("*").alias("c")).select("seq", F.concat(F.lit("direct:"), "p").alias("feature"), (w.direct * F.col("c")).alias("v"))
    skip = ahead.filter("k > 0").groupBy("seq", pair.alias("p")).agg(F.sum(1.0 / (F.col("k") + 1)).alias("c")).select("seq", F.concat(F.lit("skip:"), "p").alias("feature"), (w.skip * F.col("c")).alias("v"))
    ends = [distinct.select("seq", F.concat(F.lit(name), F.element_at("apis", at)).alias("feature"), F.lit(w.endpoint).alias("v")) for name, at in (("start:", 1), ("end:", -1))]
    return seen.union(often).union(direct).union(skip).union(ends[0]).union(ends[1])


def norms(distinct: DataFrame, vector: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """seq, len (scaled by the longest sequence) and norm."""
    longest = distinct.agg(F.max("length").alias("longest"))
    lengths = distinct.join(F.broadcast(longest)).select("seq", (weights.length * F.log(F.col("length") + 1.0) / F.log(F.col("longest") + 1.0)).alias("len"))
    return vector.groupBy("seq").agg(F.sum(F.col("v") * F.col("v")).alias("s")).join(lengths, "seq").select("seq", "len", F.sqrt(F.col("s") + F.col("len") * F.col("len")).alias("norm"))


def close_pairs(vector: DataFrame, norm: DataFrame, eps: float, names: DataFrame | None = None) -> DataFrame:
    """(a, b, dist), a < b, of all pairs with cosine distance up to ``eps`` (below 1); by ``names`` (seq, name) if given."""
    names = norm.select("seq", F.col("seq").alias("name")) if names is None else names
    return blocks.close(blocks.packed(names, vector, norm, "name"), eps, "name")


def kth_distances(distinct: DataFrame, pairs: DataFrame | None, vector: DataFrame, norm: DataFrame, min_samples: int, total: int) -> DataFrame:
    """seq, n, k_dist: the distance of the k-th nearest other session, k = max(1, min(min_samples - 1, total - 1)).

    All distances count, so ``pairs`` (the close ones) is not read. A lone session has no such distance.
    """
    return nearest_sessions(blocks.packed(distinct, vector, norm, "n"), max(1, min(min_samples - 1, total - 1)))


def nearest_sessions(vectors: DataFrame, k: int) -> DataFrame:
    """``kth_distances`` of packed vectors: the ``k`` nearest of every block have the nearest of all."""
    own = vectors.select("at", F.lit(0.0).alias("dist"), (F.col("n") - 1).alias("m"))
    within = Window.partitionBy("at").orderBy("dist").rangeBetween(Window.unboundedPreceding, 0)
    reached = own.union(blocks.nearest(vectors, k)).withColumn("reach", F.sum("m").over(within)).filter(F.col("reach") >= k)
    return vectors.select("at", "seq", "n").join(reached.groupBy("at").agg(F.min("dist").alias("k_dist")), "at").drop("at")


def elbow(k_dist: DataFrame) -> float:
    """The k-distance farthest from the chord of the falling curve; the first of equals. Distinct values are placed range by range."""
    runs = before(k_dist.groupBy("k_dist").agg(F.sum("n").alias("n")), [F.desc("k_dist")], "x0", "n")
    whole = runs.agg((F.sum("n") - 1).alias("last"), F.max("k_dist").alias("high"), F.min("k_dist").alias("low"))
    runs = runs.crossJoin(F.broadcast(whole))  # one row
    ends = runs.select("*", F.explode(F.array(F.col("x0"), F.col("x0") + F.col("n") - 1)).alias("x"))
    away = F.abs((F.col("low") - F.col("high")) * F.col("x") - F.col("last") * F.col("k_dist") + F.col("last") * F.col("high")) / F.sqrt((F.col("low") - F.col("high")) ** 2 + F.col("last").cast("double") ** 2)
    best = ends.select(F.round(away, 12).alias("away"), "x", "k_dist").orderBy(F.desc("away"), "x").first()
    return 0.0 if best is None else float(best.k_dist)


def dbscan(vectors: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """seq and cluster (from 0 by smallest core session; -1 is noise) of packed vectors.

    A sequence is core if sessions within ``eps``, its own included, reach ``min_samples``. Clusters are the
    components of core sequences; a border sequence joins the adjacent cluster that comes first.
    """
    others = blocks.reach(vectors, eps)
    core = written(vectors.join(others, "at", "left").filter(F.col("n") + F.coalesce("others", F.lit(0)) >= min_samples).select(*vectors.columns))
    rooted = components(core.select(F.col("at").alias("node")), blocks.links(core, eps)).withColumnRenamed("node", "at").join(core.select("at", "first"), "at")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    number = before(heads, [F.asc("head")], "cluster").select("root", F.col("cluster").cast("int").alias("cluster"))
    cores = written(rooted.join(number, "root").select("at", "cluster"))
    border = blocks.least_cluster(vectors.join(cores, "at", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1))), eps)
    return vectors.select("at", "seq").join(cores.union(border), "at", "left").select("seq", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def medoids(distinct: DataFrame, labels: DataFrame, vector: DataFrame, norm: DataFrame) -> DataFrame:
    """cluster, seq, total: the member with the least sum of distances to its cluster; the earliest session of equals.

    Distances are 1 less a product of unit vectors, so a member's sum is the cluster's size less its product
    with the sum of the cluster's unit vectors: all distances count and no pair is formed.
    """
    member = written(labels.filter("cluster >= 0").join(distinct.select("seq", "n", "first"), "seq"))
    size = member.groupBy("cluster").agg(F.sum("n").alias("size"))
    length = norm.select("seq", F.lit("len").alias("feature"), F.col("len").alias("v"))
    units = written(vector.union(length).join(norm.select("seq", "norm"), "seq").join(member.select("seq", "cluster", "n"), "seq").select("cluster", "seq", "n", "feature", (F.col("v") / F.col("norm")).alias("u"), F.pmod(F.hash("seq"), F.lit(SALTS)).alias("salt")))
    # nearly all members may have a feature, so each sum is dealt to several tasks
    sums = units.groupBy("cluster", "feature").agg(F.sum(F.col("n") * F.col("u")).alias("s")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dots = units.join(sums, ["cluster", "feature", "salt"]).groupBy("seq").agg(F.sum(F.col("u") * F.col("s")).alias("dot"))
    total = member.join(size, "cluster").join(dots, "seq").withColumn("total", F.greatest(F.col("size") - F.col("dot"), F.lit(0.0)))
    least = total.groupBy("cluster").agg(F.min(F.struct(F.round("total", 9).alias("rounded"), "first", "seq", "total")).alias("m"))
    return least.select("cluster", "m.seq", "m.total")


def largest_clusters(summary: DataFrame, most: int = 0) -> DataFrame:
    """The first ``most`` rows of a summary, all for 0: the largest clusters, of equals the earlier number."""
    return summary.orderBy(F.desc("cluster_size"), "cluster").limit(most) if most else summary


def cluster_summary(distinct: DataFrame, labels: DataFrame, medoid: DataFrame, min_size: int = 3) -> DataFrame:
    """Clusters of at least ``min_size`` sessions: size, lengths, representative; largest first."""
    member = labels.filter("cluster >= 0").join(distinct, "seq")
    sizes = member.groupBy("cluster").agg(F.sum("n").alias("cluster_size"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.round(F.sum(F.col("n") * F.col("length")) / F.sum("n"), 3).alias("avg_length"))
    named = medoid.join(distinct.select("seq", F.col("first").alias("representative"), F.array_join("apis", ">").alias("representative_trace")), "seq").drop("seq", "total")
    return sizes.filter(F.col("cluster_size") >= min_size).join(named, "cluster").orderBy(F.desc("cluster_size"), "cluster")


def members(found: dict, session: str = "session_id", limit: int = 0) -> DataFrame:
    """cluster, session, distance to the representative, length, trace: each member but the representative.

    With a ``limit`` the nearest of each cluster, by distance and session; partial limits go before the shuffle.
    """
    distinct, labels, medoid = found["distinct"], found["labels"], found["medoids"].select("cluster", F.col("seq").alias("centre"))
    unit = found["vector"].union(found["norm"].select("seq", F.lit("len"), "len")).join(found["norm"].select("seq", "norm"), "seq").select("seq", "feature", (F.col("v") / F.col("norm")).alias("u"))
    centres = unit.join(medoid, F.col("seq") == F.col("centre")).select("cluster", "feature", F.col("u").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mine = unit.join(labels.filter("cluster >= 0"), "seq").withColumn("salt", F.pmod(F.hash("seq"), F.lit(SALTS)))
    dots = mine.join(centres, ["cluster", "feature", "salt"], "left").groupBy("cluster", "seq").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    away = dots.select("cluster", "seq", F.round(clamp(1 - F.coalesce("dot", F.lit(0.0)), 0.0, 1.0), 6).alias("distance"))
    heads = medoid.join(distinct.select(F.col("seq").alias("centre"), F.col("first").alias(session)), "centre").select("cluster", session)
    rows = found["of"].join(away, "seq").join(distinct.select("seq", "length", F.array_join("apis", ">").alias("trace")), "seq").join(heads, ["cluster", session], "left_anti")
    if limit:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", session))).filter(F.col("r") <= limit)
    return rows.select("cluster", session, "distance", "length", "trace")


def noise_sessions(found: dict, session: str = "session_id", limit: int = 0) -> DataFrame:
    """session, length and trace of what no cluster has; with a ``limit`` the first by session."""
    rows = found["of"].join(found["labels"].filter("cluster < 0"), "seq").join(found["distinct"].select("seq", "length", F.array_join("apis", ">").alias("trace")), "seq").select(session, "length", "trace")
    return rows.orderBy(session).limit(limit) if limit else rows


def cluster_sessions(steps: DataFrame, session: str = "session_id", api: str = "api", eps: float = 0.0, min_samples: int = 3, eps_min: float = 0.15, eps_max: float = 0.6, weights: Weights = Weights()) -> dict[str, DataFrame | float]:
    """Whole run: eps (the elbow within its bounds if 0), distinct sequences, labels by sequence and by session, medoids, summary."""
    distinct, of = sequences(steps, session, api)
    vector = written(vectors(distinct, weights))
    norm = written(norms(distinct, vector, weights))
    packed = blocks.packed(distinct, vector, norm, "n", "first")
    info = {"mode": "manual", "eps": eps}
    if not eps:
        kth = written(nearest_sessions(packed, max(1, min(min_samples - 1, of.count() - 1))))
        raw = elbow(kth)
        eps = min(eps_max, max(eps_min, raw))
        low, high, avg = kth.agg(F.min("k_dist"), F.max("k_dist"), F.sum(F.col("k_dist") * F.col("n")) / F.sum("n")).first()
        info = {"mode": "auto_k_distance_elbow", "neighbor_rank": max(1, min_samples - 1), "raw_eps": raw, "eps": eps, "k_distance_min": low or 0.0, "k_distance_max": high or 0.0, "k_distance_avg": avg or 0.0}
    labels = written(dbscan(packed, eps + SLACK, min_samples))
    medoid = written(medoids(distinct, labels, vector, norm))
    return {"eps": eps, "eps_info": info, "vector": vector, "norm": norm, "of": of, "distinct": distinct, "labels": labels, "sessions": of.join(labels, "seq").select(session, "cluster"), "medoids": medoid, "summary": cluster_summary(distinct, labels, medoid)}
