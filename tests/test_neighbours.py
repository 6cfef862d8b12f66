import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywick.ml import cluster, metrics, neighbours
from tallywick.plans.lineage import in_folder


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 64)


def frame(spark, x, tags=None, parts=3):
    tags = [None] * len(x) if tags is None else tags
    return spark.createDataFrame([(k, [float(z) for z in r] if r is not None else None, t) for k, (r, t) in enumerate(zip(x, tags, strict=True))], "id long, v array<double>, c int").repartition(parts)


def points(rng, n, dims=3):
    centres = rng.normal(scale=8, size=(6, dims))
    return centres[rng.integers(0, 6, n)] + rng.normal(scale=rng.choice([0.2, 1.0], (n, 1)), size=(n, dims))


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def brute_dbscan(x, eps, least):
    d = distances(x) <= eps
    core = np.flatnonzero(d.sum(1) >= least)
    label = {}
    for i in core:
        if i not in label:
            front = [i]
            label[i] = i
            while front:
                j = front.pop()
                for k in core[d[j][core]]:
                    if k not in label:
                        label[k] = i
                        front.append(k)
    for i in range(len(x)):
        if i not in set(core):
            near = [label[j] for j in core[d[i][core]]]
            if near:
                label[i] = min(near)
    return {int(i): int(g) for i, g in label.items()}


@pytest.mark.parametrize("dims", [2, 12])
def test_nearest_rows(spark, small, dims):
    rng = np.random.default_rng(dims)
    x = points(rng, 700, dims)
    x[100:180] = x[100]  # equal rows fill blocks of their own
    x[5] = 1e3
    got = np.zeros((len(x), 6))
    for r in metrics.knn(frame(spark, x), 6, "id", "v").collect():
        got[r.id, r["rank"] - 1] = r.d
    assert np.allclose(got, np.sort(distances(x), axis=1)[:, :6], rtol=1e-12, atol=0)
    assert metrics.knn_distance_percentile(frame(spark, x), 6, 0.9, "id", "v").first()[0] == pytest.approx(np.percentile(np.sort(distances(x), axis=1)[:, 5], 90), rel=1e-12)


def test_fewer_rows_than_neighbours(spark):
    x = [[0.0, 0.0], [3.0, 4.0], None, [0.0]]  # no vector; a shorter one
    rows = metrics.knn(frame(spark, x), 5, "id", "v").collect()
    assert sorted((r.id, r["rank"], r.d) for r in rows) == sorted((i, k + 1, d) for i, ds in ((0, (0, 0, 5)), (1, (0, 5, 5)), (3, (0, 0, 5))) for k, d in enumerate(ds))
    assert metrics.knn(frame(spark, []), 5, "id", "v").collect() == []


@pytest.mark.parametrize("eps", [0.15, 0.6, 2.0])
def test_density_clusters(spark, small, eps):
    rng = np.random.default_rng(7)
    x = points(rng, 600)
    with in_folder(spark) as folder:
        got = {r.id: r.label for r in neighbours.density_clusters(frame(spark, x), folder, eps, 5, "id", "v").collect()}
    assert got == brute_dbscan(x, eps, 5)


def test_density_on_a_grid_whose_steps_are_exactly_eps(spark, small):
    x = np.array([(i, j) for i in range(15) for j in range(15)], float)
    with in_folder(spark) as folder:
        got = {r.id: r.label for r in neighbours.density_clusters(frame(spark, x), folder, 1.0, 5, "id", "v").collect()}
    assert got == brute_dbscan(x, 1.0, 5) and len(got) == 221  # the corners touch border rows only


def test_silhouette(spark, small):
    rng = np.random.default_rng(3)
    x = points(rng, 500)
    c = rng.integers(0, 4, 500)
    c[17] = 9  # a cluster of one
    d, s = distances(x), []
    for i in range(len(x)):
        own = c == c[i]
        a = d[i][own].sum() / max(own.sum() - 1, 1)
        b = min(d[i][c == k].mean() for k in set(c) if k != c[i])
        s.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
    df = frame(spark, x, [int(k) for k in c])
    value, n, error = metrics.silhouette(df, "id", "v", "c").first()
    assert value == pytest.approx(np.mean(s), rel=1e-9) and (n, error) == (500, 0.0)
    value, n, error = metrics.silhouette(df, "id", "v", "c", rows=200).first()
    assert 120 < n < 280 and 0 < error < 0.1 and abs(value - np.mean(s)) < 4 * error
    assert metrics.silhouette(frame(spark, x[:9], [1] * 9), "id", "v", "c").first()[0] == 0.0
    assert metrics.silhouette(frame(spark, []), "id", "v", "c").first()[1] == 0


def test_two_hundred_thousand_rows(spark):
    """A chain that winds through several groups, a hundred blobs, and noise."""
    n = 60_000
    t = np.arange(n)[:, None] * 0.01
    chain = np.hstack([50 * np.sin(t / 50), 50 * np.cos(t / 50), 0.05 * t])
    rng = np.random.default_rng(0)
    blobs = np.repeat([[200.0 + 50 * i, 50.0 * j, 0] for i in range(10) for j in range(10)], 1_380, axis=0) + rng.normal(scale=0.8, size=(138_000, 3))
    noise = rng.uniform(1000, 1e6, (2_000, 3))
    x = np.vstack([chain, blobs, noise])
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})).select("id", F.array("a", "b", "c").alias("v"))
    with in_folder(spark) as folder:
        sizes = {r.label: r["count"] for r in neighbours.density_clusters(df, folder, 0.5, 4, "id", "v").groupBy("label").count().collect()}
    # the blobs' outskirts may be noise or small clusters
    assert sizes[0] == n and sum(1_200 < s <= 1_380 for s in sizes.values()) == 100 and max(sizes) < 198_000
    with in_folder(spark) as folder:
        kth = neighbours.nearest(df, folder, 5, "id", "v").where("rank = 5 AND id % 4001 = 0").collect()
    assert len(kth) == 50
    for r in kth:
        assert r.d == pytest.approx(np.partition(np.sqrt(((x - x[r.id]) ** 2).sum(1)), 4)[4], rel=1e-12)


def test_numbers_go_by_first_row(spark):
    labels = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "label long")
    with in_folder(spark) as folder:
        got = {r.label: r.number for r in cluster.numbers(labels, folder).collect()}
        assert got == {k: k for k in range(101)}
        assert cluster.numbers(labels.where("false"), folder).collect() == []
