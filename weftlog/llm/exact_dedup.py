"""Exact dedup by a tree-merge of sorted digest runs.

Each partition of documents gives sorted runs of (digest, length, best id, rows): one entry per distinct
text, so a text that fills a third of the table has one entry per run. Runs are cut into slices of the
digest space, sized so that a merged slice fits a task. Runs of a slice then meet in rounds of a tree:
round after round, ``FAN_IN`` neighbouring runs are merged in one pass (binomial rounds of that arity),
equal digests collapsing to the best id, until one run per slice is left. An entry is merged only after
its second fingerprint and its length agree too, so a collision of one hash never joins two texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import join_hot, text_or_empty, written

FAN_IN = 8
#: Entries in one run at most, and about so many in a merged slice.
RUN_ENTRIES = 200_000
SLICE_ENTRIES = 100_000

RUN = pa.schema([("slice", pa.int32()), ("run", pa.int64()), ("digest", pa.binary()), ("check", pa.int64()), ("n_bytes", pa.int64()), ("best", pa.int64()), ("n", pa.int64()), ("n_best", pa.int64())])
RUN_DDL = "slice int, run bigint, digest binary, `check` bigint, n_bytes bigint, best bigint, n bigint, n_best bigint"


def _better(a: int | None, b: int | None, largest: bool) -> bool:
    if a is None or b is None:
        return b is None and a is not None
    return a > b if largest else a < b


def _fold(entries: Iterator[tuple], largest: bool) -> Iterator[tuple]:
    """Entries (digest, check, n_bytes, best, n, n_best) in order of the first three; one for each distinct text."""
    last = None
    for e in entries:
        if last is not None and last[:3] == e[:3]:
            if last[3] == e[3]:
                last = (*last[:4], last[4] + e[4], last[5] + e[5])
            elif _better(e[3], last[3], largest):
                last = (*last[:3], e[3], last[4] + e[4], e[5])
            else:
                last = (*last[:4], last[4] + e[4], last[5])
        else:
            if last is not None:
                yield last
            last = e
    if last is not None:
        yield last


def _slice(digest: bytes, slices: int) -> int:
    return int.from_bytes(digest[:4], "big") * slices >> 32


def _batch(entries: list[tuple], run: int, slices: int) -> pa.RecordBatch:
    cols = list(zip(*entries, strict=True)) if entries else [[] for _ in range(6)]
    head = [pa.array([_slice(e[0], slices) for e in entries], pa.int32()), pa.array([run] * len(entries), pa.int64())]
    return pa.record_batch([*head, *(pa.array(c, RUN.field(i + 2).type) for i, c in enumerate(cols))], schema=RUN)


def _first_runs(slices: int, largest: bool):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}

        def run() -> pa.RecordBatch:
            return _batch(sorted((*key, *v) for key, v in seen.items()), part, slices)

        for batch in batches:
            for digest, check, n_bytes, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (digest, check, n_bytes)
                old = seen.get(key)
                seen[key] = (doc, 1, 1) if old is None else next(_fold(iter([(*key, *old), (*key, doc, 1, 1)]), largest))[3:]
            if len(seen) >= RUN_ENTRIES:
                yield run()
                seen = {}
        if seen:
            yield run()

    return build


def _merge(slices: int, largest: bool):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        runs: dict[int, list] = {}
        for run, *entry in zip(*(table.column(c).to_pylist() for c in ("run", "digest", "check", "n_bytes", "best", "n", "n_best")), strict=True):
            runs.setdefault(run, []).append(tuple(entry))
        # a shuffle may deliver a run's rows in any order; sorting what is nearly sorted is one pass
        merged = heapq.merge(*(sorted(r, key=lambda e: e[:3]) for r in runs.values()), key=lambda e: e[:3])
        return pa.Table.from_batches([_batch(list(_fold(merged, largest)), key[1].as_py(), slices)], RUN)

    return merge


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    body = text_or_empty(text)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"), F.xxhash64(body).alias("check"), F.octet_length(body).cast("bigint").alias("n_bytes"))


def merged_runs(thin: DataFrame, total: int, keep: str) -> DataFrame:
    """One entry for each distinct text: digest, check, n_bytes, best (the id that stays), n (its rows) and n_best (rows with that id)."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    largest = keep == "largest"
    slices = max(1, min(2**31 - 1, total // SLICE_ENTRIES + 1))
    runs = written(thin.select("digest", "check", "n_bytes", "id").mapInArrow(_first_runs(slices, largest), RUN_DDL), "runs")
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        left = -(-left // FAN_IN)
        # early rounds span few partitions and need few slices; the last has them all
        coarse = max(1, min(slices, slices // left if left > 1 else slices))
        part = F.floor(F.col("slice") * coarse / slices).cast("int").alias("part")
        runs = runs.groupBy(part, F.floor(F.col("run") / FAN_IN).cast("bigint").alias("up")).applyInArrow(_merge(slices, largest), RUN_DDL)
        if left == 1:
            break
    return written(runs.select("digest", "check", "n_bytes", "best", "n", "n_best"), "texts")


def exact_groups(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, digest (SHA-256), keep_id, group_size, kept.

    ``keep`` is "largest" or "smallest" id. A null text is empty; a null id stays only if its group has no
    other, and then ``keep_id`` is null. Of rows alike in both id and text one is kept. No rows, no result.
    """
    total = docs.count()
    thin = written(digests(docs, id_col, text), "digests")
    key = F.concat("digest", F.unhex(F.hex("check"))).alias("key")
    texts = merged_runs(thin, total, keep).select(key, "best", "n")
    rows = thin.groupBy("id", "digest", key).agg(F.count("*").cast("int").alias("copies"))
    found = join_hot(rows, texts, "key", "n", total, F.xxhash64("id"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select("id", "digest", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), (F.col("id").eqNullSafe(F.col("best")) & (F.col("copy") == 1)).alias("kept"))


def keep_one(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; ties and nulls as in ``exact_groups``."""
    total = docs.count()
    texts = merged_runs(written(digests(docs, id_col, text), "digests"), total, keep)
    body = text_or_empty(text)
    mine = ["__id", "__digest", "__check"]
    tagged = docs.withColumns({"__id": F.col(id_col).cast("bigint"), "__digest": F.unhex(F.sha2(body, 256)), "__check": F.xxhash64(body)})
    stays = texts.select(F.col("best").alias("__b"), F.col("digest").alias("__d"), F.col("check").alias("__c"))
    # the id is part of the key, so a text's many copies do not meet in one partition
    found = tagged.join(stays, F.col("__id").eqNullSafe(F.col("__b")) & (F.col("__digest") == F.col("__d")) & (F.col("__check") == F.col("__c")), "left_semi")
    if not texts.filter("n_best > 1").isEmpty():
        found = found.dropDuplicates(mine)
    return found.drop(*mine)
