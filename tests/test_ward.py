"""Agglomerative clusters of more rows than are merged pairwise."""

import numpy as np
import pandas as pd
import pytest

from tallywick.ml import cluster


def made(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [40, 40, 40]], float)
    share = rng.choice(4, n, p=[0.5, 0.3, 0.195, 0.005])  # the last is small and far
    x = centres[share] + rng.normal(scale=0.7, size=(n, 3))
    return spark.createDataFrame(pd.DataFrame({"truth": share.astype(int), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}))


def test_merges_of_weighted_points_equal_merges_of_the_rows():
    rng = np.random.default_rng(1)
    groups = rng.normal(scale=10, size=(12, 2))
    sizes = rng.integers(1, 6, 12)
    rows = np.repeat(groups, sizes, axis=0)
    by_row = [m for m in cluster.ward_merges(rows) if m[2] > 1e-9]
    by_group = cluster.ward_merges(groups, sizes)
    assert np.allclose([m[2] for m in by_row], [m[2] for m in by_group]) and [m[3] for m in by_row] == [m[3] for m in by_group]


def test_more_rows_than_are_merged(spark, monkeypatch):
    df = made(spark, 20_000)
    monkeypatch.setattr(cluster, "WARD_MOST", 300)
    engine = cluster.ClusteringEngine()
    x, _, _ = engine.prepared(df, ["x", "y", "z"])
    got = engine.ward(x, 4).groupBy("truth", "cluster").count().collect()
    assert len(got) == 4 and len({r.cluster for r in got}) == 4 and sum(r["count"] for r in got) == 20_000
    assert 0 < engine.ward_loss(x) < 0.05


def test_as_many_small_clusters_as_rows_change_nothing(spark, monkeypatch):
    df = made(spark, 400, seed=3)
    engine = cluster.ClusteringEngine()
    x, _, _ = engine.prepared(df, ["x", "y", "z"])
    plain = {r[cluster.ROW]: r.cluster for r in engine.ward(x, 7).collect()}
    assert engine.ward_loss(x) == 0.0
    pivots, small = cluster.gathered(x, 3 * 400, 42, rounds=3)
    assert len(small.n) == 400 and small.within.max() == pytest.approx(0, abs=1e-12)
    labels = cluster.cut_tree(cluster.ward_merges(small.mean, small.n), len(small.n), 7)
    again = {r[cluster.ROW]: r.cluster for r in cluster.assigned(x, pivots[small.pivot], np.array(labels, np.int32)).collect()}
    assert again == plain


def test_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(cluster, "WARD_MOST", 10)
    df = spark.createDataFrame([(float(k % 3), 1.0) for k in range(90)], "x double, y double")
    engine = cluster.ClusteringEngine()
    x, _, _ = engine.prepared(df, ["x", "y"])
    got = engine.ward(x, 3).groupBy("x", "cluster").count().collect()
    assert len(got) == 3 and engine.ward_loss(x) == pytest.approx(0, abs=1e-12)
