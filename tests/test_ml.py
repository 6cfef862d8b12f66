import itertools
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywick.ml import churn, cluster, explain, features, metrics
from tallywick.sources import sinks


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    rows = [(k, float(x), float(y)) for k, c in enumerate(centres) for x, y in rng.normal(c, 0.5, (20, 2))]
    return spark.createDataFrame(rows, "truth int, x double, y double").cache()


def agrees(result):
    pairs = {(r.truth, r.cluster) for r in result.labelled.select("truth", "cluster").distinct().collect()}
    return len(pairs) == 3 and len({c for _, c in pairs}) == 3


def test_algorithms_find_blobs(blobs):
    engine = cluster.ClusteringEngine(n_init=5, k_range=(2, 4))
    for name in ("kmeans", "gmm", "hierarchical"):
        got = engine.fit(blobs, ["x", "y"], name, n_clusters=3)
        assert agrees(got) and got.n_clusters == 3 and got.metrics["silhouette"] > 0.8, name
    dense = engine.fit(blobs, ["x", "y"], "dbscan", eps=0.6, min_samples=4)
    assert dense.n_clusters == 3 and dense.metrics["noise_ratio"] < 0.2
    assert {r["size"] for r in got.summary.collect()} == {20}
    assert got.profile(0).count() == 2 and got.profile(99).count() == 0
    with pytest.raises(ValueError):
        engine.fit(blobs, ["x", "y"], "magic", n_clusters=3)


def test_best_k_elbow_projection_tree(blobs):
    engine = cluster.ClusteringEngine(n_init=1, k_range=(2, 4))
    x, _, _ = engine.prepared(blobs, ["x", "y"])
    assert engine.best_k(x, "kmeans") == 3
    elbow = engine.elbow_data(blobs, ["x", "y"], 4).collect()
    assert [r.k for r in elbow if r.elbow] == [3] and elbow[0].inertia > elbow[1].inertia
    assert engine.projection(blobs, ["x", "y"], 2).columns[-2:] == ["pc1", "pc2"]
    tree = engine.dendrogram(blobs, ["x", "y"], 30).toPandas()
    assert len(tree) == 29 and tree["size"].iloc[-1] == 30 and tree.height.is_monotonic_increasing


def test_metrics_against_numpy(spark, blobs):
    df = blobs.withColumn("id", F.monotonically_increasing_id()).withColumn("v", F.array("x", "y"))
    p = df.toPandas()
    v, c = p[["x", "y"]].to_numpy(), p.truth.to_numpy()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    s = []
    for i in range(len(v)):
        own = c == c[i]
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][c == k].mean() for k in set(c) if k != c[i])
        s.append((b - a) / max(a, b))
    by = {"row_id": "id", "vector": "v", "cluster": "truth"}
    assert np.isclose(metrics.silhouette(df, **by).first()[0], np.mean(s))
    kth = np.sort(d, axis=1)[:, 4]
    assert np.isclose(metrics.knn_distance_percentile(df, 5, row_id="id", vector="v").first()[0], np.percentile(kth, 90))


def test_features(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 5.0, None), (4, float("nan"), "b")], "i int, x double, c string")
    assert features.numeric_columns(df) == ["i", "x"]
    assert features.medians(df, ["i", "x"]) == {"i": 2.5, "x": 3.0}
    assert [r.x for r in features.impute(df, {"x": 3.0}).orderBy("i").collect()] == [1.0, 3.0, 5.0, 3.0]
    assert [r.c for r in features.label_codes(df, ["c"]).orderBy("i").collect()] == [1, 0, None, 1]
    assert features.scaling(df, ["i"], "minmax") == {"i": (1.0, 3.0)} and features.scaling(df, ["i"], "robust")["i"] == (2.5, 1.5)
    with pytest.raises(ValueError):
        features.scaling(df, ["i"], "magic")


@pytest.fixture(scope="module")
def customers(spark):
    rng = np.random.default_rng(1)
    a, b, noise = rng.normal(size=400), rng.normal(size=400), rng.normal(size=400)
    y = (1.5 * a - b + 0.5 * rng.normal(size=400) > 0).astype(int)
    pdf = pd.DataFrame({"a": a, "b": b, "noise": noise, "plan": np.where(a > 0, "gold", "basic"), "churned": y})
    pdf.loc[::17, "b"] = np.nan
    return spark.createDataFrame(pdf).repartition(4).cache()


def test_churn_models(customers):
    predictor = churn.ChurnPredictor(trees=6, folds=3)
    for kind in ("rf", "gb", "logistic", "calibrated"):
        got = predictor.train(customers, "churned", ["a", "b", "noise"], kind=kind)
        assert got.metrics["roc_auc"] > 0.8, kind
        assert {f for f, *_ in got.importance} == {"a", "b", "noise"} and got.importance[-1][0] == "noise"
    out = got.predict(customers.drop("churned"))
    assert out.count() == 400 and {r.risk for r in out.select("risk").distinct().collect()} <= {"Low", "Medium", "High"}
    coded = predictor.train(customers, "churned", ["a"], categorical=["plan"], kind="logistic")
    assert coded.features == ["a", "plan"]
    with pytest.raises(ValueError):
        predictor.train(customers, "churned", kind="xgb")


def test_stacking_and_grid(customers):
    predictor = churn.ChurnPredictor(trees=4, folds=2)
    got = predictor.train(customers, "churned", ["a", "b"], kind="stacking")
    assert got.metrics["roc_auc"] > 0.8 and len(got.importance) == 2
    model, table = churn.ChurnPredictor(folds=2).grid_search(customers.fillna(0.0), "churned", ["a", "b"], small=True)
    assert len(table) == 2 and max(a for _, a in table) > 0.8 and model is not None


def test_explanations(customers):
    df = customers.fillna(0.0)
    linear = explain.explain_linear(df, {"a": 2.0, "b": -1.0}, intercept=0.5, most=50)
    rows = linear.values.groupBy("row_id").agg(F.sum("shap_value").alias("s"), F.sum(F.when(F.col("feature") == "a", 2 * F.col("value")).otherwise(-F.col("value"))).alias("raw")).collect()
    assert len(rows) == 50 and all(abs(linear.base_value + r.s - (0.5 + r.raw)) < 1e-9 for r in rows)  # additive
    got = explain.explain_permutation(df, lambda x: x.withColumn("score", 3 * F.col("a") + 0 * F.col("noise")), ["a", "noise"], most=60)
    assert [r.feature for r in got.importance.collect()] == ["a", "noise"]
    assert got.importance.collect()[1].importance == 0
    assert got.dependence("a")[0].count() == 60 and got.waterfall(0).count() == 2
    assert got.beeswarm().count() == 120 and len(got.dashboard()["values"]) == 100
    assert {"a_shap", "noise_shap"} <= set(got.wide(explain.sampled(df, ["a", "noise"], 60, 42)).columns)
    model = churn.ChurnPredictor(trees=4).train(df, "churned", ["a", "b"], kind="logistic")
    exact = explain.explain_model(model, df, ["a", "b"], most=30)
    assert exact.summary["n_samples"] == 30 and exact.instance(0).count() == 2


def shapley(leaves, x):
    """Shapley values of one row by the definition, over all sets of features."""
    n = len(x)

    def known(features):
        return sum(leaf.value * math.prod(float(a < x[f] <= b) if f in features else share for f, (a, b, share) in leaf.bounds.items()) for leaf in leaves)

    out = np.zeros(n)
    for i in range(n):
        others = [f for f in range(n) if f != i]
        for k in range(n):
            for s in itertools.combinations(others, k):
                out[i] += math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (known({*s, i}) - known(set(s)))
    return out


def test_tree_explanations_are_exact(customers, tmp_path):
    df = customers.fillna(0.0)
    columns = ["a", "b", "noise"]
    for kind in ("rf", "gb"):
        model = churn.ChurnPredictor(trees=4).train(df, "churned", columns, kind=kind)
        leaves = explain.leaves_of(model.model.model)
        x = np.random.default_rng(2).normal(size=(6, 3))
        assert np.allclose(explain.leaf_effects(leaves, x), [shapley(leaves, r) for r in x])
        got = explain.explain_model(model, df, columns, most=25)
        rows = explain.sampled(df, columns, 25, 42)
        scores = {r.row_id: r.score for r in model.predict(rows).collect()}
        for r in got.values.groupBy("row_id").agg(F.sum("shap_value").alias("s")).collect():
            total = got.base_value + r.s
            assert abs((1 / (1 + math.exp(-total)) if kind == "gb" else total) - scores[r.row_id]) < 1e-6
        one = got.instance(0).collect()
        assert {r.predicted for r in one} == {int(scores[0] >= 0.5)} and abs(one[0].confidence - max(scores[0], 1 - scores[0])) < 1e-6
    made = sinks.export_explanation(got, rows, str(tmp_path / "e")) | sinks.export_churn(model, df, str(tmp_path / "c"))
    assert set(made) == {"explanations", "explained_importance", "predictions", "importance"} and all(os.path.isdir(p) for p in made.values())


def test_clusters_of_more_rows_than_merging_allows(blobs, monkeypatch, tmp_path):
    monkeypatch.setattr(cluster, "WARD_MOST", 30)
    got = cluster.ClusteringEngine(n_init=3, k_range=(2, 3)).fit(blobs, ["x", "y"], "auto")
    assert got.algorithm in ("kmeans", "gmm", "dbscan") and got.metrics["silhouette_error"] == 0 and got.metrics["silhouette"] > 0.8
    made = sinks.export_clusters(got, str(tmp_path / "k"))
    assert set(made) == {"clusters", "summary"} and blobs.sparkSession.read.option("header", True).csv(made["summary"]).count() == got.n_clusters


def test_splits_keep_shares_and_are_the_same_on_every_run(customers):
    df = customers.select("a", "b", F.col("churned").alias("label"))
    predictor = churn.ChurnPredictor()
    parts = [predictor.stratified(x) for x in (df, df.repartition(7).orderBy("b"))]
    assert [sorted(map(str, p[1].collect())) for p in parts][0] == sorted(map(str, parts[1][1].collect()))
    for label in (0, 1):
        n, m = df.where(f"label = {label}").count(), parts[0][1].where(f"label = {label}").count()
        assert abs(m - 0.2 * n) <= 1
    folds = predictor._folded(df).groupBy("_fold", "label").count().collect()
    assert len(folds) == 10 and max(r["count"] for r in folds if r.label) - min(r["count"] for r in folds if r.label) <= 2
