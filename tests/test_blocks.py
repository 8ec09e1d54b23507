"""Distances block against block: equal to one product, and no table of pairs."""

import glob
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlog.operators import blocks, mining
from weftlog.operators.graph import shared_dir


def some_steps(spark, n):
    rng = random.Random(3)
    seqs = sorted({tuple(rng.choice("abcde") for _ in range(rng.randint(5, 9))) for _ in range(n)})
    return spark.createDataFrame([(f"s{i:04}", k + 1, a) for i, s in enumerate(seqs) for k, a in enumerate(s)], "session_id string, step int, api string").repartition(4), len(seqs)


def most_rows(spark, run):
    """Rows of the largest table written by ``run``."""
    tables = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/weftlog-*"))
    old = tables()
    run()
    return max(spark.read.parquet(t).count() for t in tables() - old)


@pytest.mark.parametrize("eps", [0.3, 0.0])
def test_no_table_of_pairs(spark, eps):
    """Most sequences share most features: what is written grows with the sequences, not with their pairs."""
    steps, n = some_steps(spark, 500)
    assert most_rows(spark, lambda: mining.cluster_sessions(steps, eps=eps)) < 60 * n


def test_close_pairs_writes_no_candidates(spark):
    """Of all pairs only the close ones become rows, by the names given."""
    steps, n = some_steps(spark, 500)
    distinct, _ = mining.sequences(steps)
    vector, names = mining.vectors(distinct), distinct.select("seq", F.array_join("apis", ">").alias("name"))
    norm, found = mining.norms(distinct, vector), []
    assert most_rows(spark, lambda: found.extend(mining.close_pairs(vector, norm, 0.3, names).collect())) < 60 * n
    assert found and all(r.a < r.b and r.dist <= 0.3 and "," not in r.a and ">" in r.a for r in found)
    assert len({(r.a, r.b) for r in found}) == len(found)


@pytest.mark.parametrize("cells", [1, 37, 1 << 21])
def test_slices_equal_one_product(monkeypatch, cells):
    monkeypatch.setattr(blocks, "CELLS", cells)
    rng = np.random.default_rng(4)
    dense = rng.random((30, 12)) * (rng.random((30, 12)) < 0.4)
    dense[:, 0] = 1
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    ids = [np.flatnonzero(r) * 1000 - 1 for r in dense]
    table = pa.table({"ids": [i.tolist() for i in ids], "units": [r[r != 0].tolist() for r in dense]})
    left, right = blocks.Block(table.slice(0, 11)), blocks.Block(table.slice(11))
    got = np.vstack([d for _, d in blocks.distances(left, right, False)])
    assert np.allclose(got, np.clip(1 - dense[:11] @ dense[11:].T, 0, 1), atol=1e-12)
    own = np.vstack([d for _, d in blocks.distances(left, left, True)])
    assert np.isinf(np.diag(own)).all() and np.isfinite(own).sum() == 110
    assert not list(blocks.distances(left.where(np.zeros(11, dtype=bool)), right, False))
