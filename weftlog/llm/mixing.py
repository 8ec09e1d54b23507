"""Mixing sources to target weights by hash-threshold histograms.

Each document has a uniform key of 60 bits. For a source that is to give e whole passes and a rest, each of
its documents is taken e times, and once more if its key lies below the source's threshold. The threshold
is found without sorting: words are summed by source and leading 12 bits of the key, the bucket in which
the running sum passes the rest is the boundary bucket, and only its documents are summed again by the next
12 bits, until the bits are used up. Thresholds of larger budgets are larger, so samples are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.common import FEW, WORD, seeded_key, text_or_empty, written

LEVELS, BITS = 5, 12
#: Sources up to which the per-source table is broadcast; beyond, rows are salted and joined by shuffle.
BROADCAST_SOURCES = FEW
SALTS = 64


def n_words(text: str = "text") -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def by_source(rows: DataFrame, table: DataFrame, n_sources: int, salt: Column) -> DataFrame:
    """Join rows with a table of one row per ``__s``: broadcast if the counted sources are few, else salted."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), "__s")
    rows = rows.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(table, ["__s", "__salt"]).drop("__salt")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """``__s``, source_size, target: the water level of the weights under a cap of ``most`` times each size.

    ``sizes`` has one row per source (``__s``, source_size). Sources in code point order, null last, weigh
    ``weights`` repeating; share[0] / share[1] of all words are dealt, and what a source cannot take is dealt
    to the others by weight again until none is above its cap. Caps are met in order of cap by weight, so
    the level follows from running sums of integers; the one division makes the result the same anywhere.
    The windows run over one row per source, not over documents. Products of words and weights are decimals, which
    hold them at any size.
    """
    order = Window.orderBy("__s")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("bigint")
    by_cap = Window.orderBy((F.col("cap") / F.col("w")).asc(), "__s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    t = t.withColumns({
        "caps": F.coalesce(F.sum("cap").over(by_cap), F.lit(0)), "used": F.coalesce(F.sum("w").over(by_cap), F.lit(0)),
        "all_w": F.sum("w").over(whole), "budget": F.sum("source_size").over(whole) * share[0],
    })
    # dealt by weight among this and all later sources; the first that stays below its cap sets the level
    whole_number = lambda c: c.cast("decimal(19,0)")
    over = whole_number(F.col("budget") - share[1] * F.col("caps"))
    under = whole_number(share[1] * (F.col("all_w") - F.col("used")))
    below = over * whole_number(F.col("w")) <= whole_number(F.col("cap")) * under
    level = F.min(F.when(below, F.struct((F.col("cap") / F.col("w")).alias("ratio"), F.col("__s"), over.alias("over"), under.alias("under")))).over(whole)
    t = t.withColumn("level", level)
    after = F.struct((F.col("cap") / F.col("w")).alias("ratio"), F.col("__s")) >= F.struct(F.col("level.ratio"), F.col("level.__s"))
    target = F.when(after, (F.col("level.over") * whole_number(F.col("w"))).cast("double") / F.col("level.under").cast("double")).otherwise(F.col("cap").cast("double"))
    return t.select("__s", "source_size", target.alias("target"))


def thresholds(thin: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    """``__s``, passes and threshold for each source of ``goals``; thin has __s, __k and __size.

    The first level sums all rows; the rows of its boundary buckets, a 4096th of each source, are then written, and
    the later levels read these alone. The last boundary bucket is taken if that brings the source nearer to its target.
    A source without words has the threshold 0 or that of its last key; rows that share a key are taken alike; without
    rows there are no thresholds.
    """
    state = goals.select("__s", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("int").alias("passes"), "target", "source_size")
    state = state.select("__s", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"), F.lit(0).cast("bigint").alias("low"))
    rows = thin
    for level in range(1, LEVELS + 1):
        width = LEVELS * BITS - level * BITS
        bucket = F.shiftright("__k", width)
        inside = by_source(rows, state.select("__s", "low"), n_sources, F.col("__k"))
        if level > 1:
            inside = inside.filter((F.col("__k") >= F.col("low")) & (F.shiftright("__k", width + BITS) == F.shiftright("low", width + BITS)))
        if level == 2:
            rows = inside = written(inside.drop("low"), "boundary")
        sums = inside.groupBy("__s", bucket.alias("b")).agg(F.sum("__size").alias("sum"))
        running = Window.partitionBy("__s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
        sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(running), F.lit(0)))
        # the boundary bucket is the first whose end passes the rest; if none does, all of the bucket above is taken
        edge = sums.join(state.select("__s", "rest"), "__s").groupBy("__s").agg(
            F.min(F.when(F.col("before") + F.col("sum") > F.col("rest"), F.struct("b", "before", "sum"))).alias("cut"), (F.max("b") + 1).alias("end"), F.sum("sum").alias("total"),
        )
        state = state.join(edge, "__s", "left").select(
            "__s", "passes",
            F.when(F.col("cut").isNotNull(), F.col("rest") - F.col("cut.before")).otherwise(F.greatest(F.lit(0.0), F.col("rest") - F.coalesce("total", F.lit(0)))).alias("rest"),
            F.when(F.col("cut").isNotNull(), F.shiftleft(F.col("cut.b"), width)).when(F.col("end").isNotNull(), F.shiftleft(F.col("end"), width)).otherwise(F.col("low")).alias("low"),
            F.coalesce(F.col("cut.sum"), F.lit(0)).alias("last"),
        )
        state = written(state, "thresholds")
    return state.select("__s", "passes", (F.col("low") + F.when((F.col("last") > 0) & (2 * F.col("rest") >= F.col("last")), 1).otherwise(0)).alias("threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, source: str = "source", id_col: str = "doc_id", text: str = "text", seed: int = 23, words: Column | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``size`` (words), ``source_size``, ``target`` and ``copies`` (0 to ``most``).

    A null source counts as one, after all others; a null or empty text has size 0. Rows with the same id
    have the same key and so are taken alike. Columns of the new names that the input has are replaced.
    An empty table gives an empty result. ``words`` is a size already counted.
    """
    new = ("size", "source_size", "target", "copies")
    docs = docs.drop(*new)
    s = F.when(F.col(source).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(source).cast("string")))
    n = n_words(text) if words is None else words.cast("bigint")
    thin = written(docs.select(s.alias("__s"), seeded_key(seed, id_col).alias("__k"), n.alias("__size")), "sizes")
    sizes = written(thin.groupBy("__s").agg(F.sum("__size").alias("source_size")), "source-sizes")
    n_sources = sizes.count()
    goals = written(targets(sizes, weights, share, most), "targets")
    table = goals.join(thresholds(thin, goals, n_sources), "__s")
    own = [f"`{c}`" for c in docs.columns]
    tagged = docs.withColumns({"__s": s, "__k": seeded_key(seed, id_col), "size": n})
    joined = by_source(tagged, table, n_sources, F.col("__k"))
    # a source at its cap has a threshold above documents without words, which get no further copy either
    copies = F.least(F.col("passes") + F.when(F.col("__k") < F.col("threshold"), 1).otherwise(0), F.lit(most))
    return joined.select(*own, "size", "source_size", "target", copies.cast("int").alias("copies"))


def taken_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, without the columns that ``mix`` added."""
    rows = mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.drop("size", "source_size", "target", "copies", "__copy")
