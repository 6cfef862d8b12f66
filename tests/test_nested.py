import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallywick.ml import churn, nested
from tallywick.ml import features as prep


@pytest.fixture(scope="module")
def x(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    df = spark.range(600).select("id", (F.col("id") % 83).cast("double").alias("a"), noise.alias("b"))
    df = df.withColumn("label", (F.col("a") / 83 + noise > 0.9 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 400).cast("int"))
    return prep.vectors(df, ["a", "b"]).cache()


def scores(model, x):
    return np.array([r.p for r in model.transform(x).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()])


def prefix(model, x, n):
    return np.array([r[0] for r in nested.prefix_scores(model, x, [n], ["id", "label"]).orderBy("id").select(f"score_{n}").collect()])


def test_all_trees_of_a_forest_give_its_score_and_a_prefix_their_mean(x):
    model = RandomForestClassifier(numTrees=7, maxDepth=6, seed=3).fit(x)
    assert np.allclose(prefix(model, x, 7), scores(model, x))
    first = np.array([[r.p] for r in model.trees[0].transform(x).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()])[:, 0]
    assert np.allclose(prefix(model, x, 1), first)


def test_first_rounds_are_the_model_of_so_many_rounds(x):
    longer, shorter = (GBTClassifier(maxIter=n, maxDepth=3, stepSize=0.1, seed=5).fit(x) for n in (6, 3))
    assert np.allclose(prefix(longer, x, 3), scores(shorter, x)) and np.allclose(prefix(longer, x, 6), scores(longer, x))


def test_no_rows(x):
    model = RandomForestClassifier(numTrees=2, maxDepth=2, seed=3).fit(x)
    assert nested.prefix_scores(model, x.limit(0), [1, 2], ["label"]).columns == ["label", "score_1", "score_2"]
    assert nested.prefix_scores(model, x.limit(0), [1, 2], ["label"]).count() == 0


def test_grid_points_come_from_one_fit_each(x, monkeypatch):
    fits = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    best, table = churn.ChurnPredictor(folds=2).grid_search(x.select("a", "b", "label"), "label", ["a", "b"], small=True)
    assert len(fits) == 3 and [p["numTrees"] for p, _ in table] == [50, 100]
    assert best.getNumTrees == max(table, key=lambda t: t[1])[0]["numTrees"] and all(a > 0.8 for _, a in table)
    with pytest.raises(ValueError, match="no grid"):
        churn.ChurnPredictor().grid_search(x, "label", kind="logistic")


def test_first_levels_are_the_forest_of_that_depth(x):
    """Equal to the score of a forest fitted with the smaller depth, leaves of one class merged."""
    for strategy in ("sqrt", "all"):
        forest = lambda depth: RandomForestClassifier(numTrees=9, maxDepth=depth, seed=3, featureSubsetStrategy=strategy).fit(x)  # noqa: B023, E731
        deep = forest(9)
        got = nested.prefix_scores(deep, x, [4, 9], ["id", "label"], [1, 2, 5, 9, 12]).orderBy("id").toPandas()
        for depth in (1, 2, 5, 9):
            assert np.allclose(got[f"score_9_{depth}"], scores(forest(depth), x)), depth
        assert (got.score_9_12 == got.score_9_9).all() and (got.score_4_5 != got.score_9_5).any()
    with pytest.raises(ValueError, match="boosted"):
        nested.prefix_scores(GBTClassifier(maxIter=2, maxDepth=2).fit(x), x, [2], ["id"], [1])


def test_areas_of_several_scores_are_those_of_each(spark, x):
    from tallywick.ml import metrics

    rows = x.select("label", "a", "b", F.round("b", 1).alias("tied"), F.lit(1.0).alias("same"))
    want = [metrics.roc_auc(rows, score=c).first()[0] for c in ("a", "b", "tied", "same")]
    assert np.allclose(metrics.roc_auc_each(rows, ["a", "b", "tied", "same"]), want) and want[3] == 0.5
    assert metrics.roc_auc_each(rows.where("label = 1"), ["a"]) == [None] and metrics.roc_auc_each(rows.limit(0), ["a", "b"]) == [None, None]


def test_the_whole_grid_has_every_point(x, monkeypatch):
    fits = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, rows, p: fits.append({k.name: v for k, v in p.items()}) or fit(self, rows, p))
    rows = x.select("a", "b", "label").where("id % 3 = 0")
    _, table = churn.ChurnPredictor(folds=2).grid_search(rows, "label", ["a", "b"])
    points = [tuple(p[n] for n in ("numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy")) for p, _ in table]
    assert len(table) == len(set(points)) == 3 * 4 * 3 * 3
    # of two columns sqrt means 2, log2 1 and all 2: two fits for each least number of rows and fold, and the best
    assert len(fits) == 3 * 2 * 2 + 1 and {f["maxDepth"] for f in fits[:-1]} == {20} and {f["numTrees"] for f in fits[:-1]} == {200}
    areas = dict(zip(points, (a for _, a in table), strict=True))
    assert len({areas[200, d, 1, "all"] for d in (5, 10, 15, 20)}) > 1 and all(a > 0.7 for a in areas.values())


def test_the_registered_grid_is_the_whole_one(spark, monkeypatch):
    from tallywick.plans import catalogue

    asked = {}

    def grid(self, df, target, columns=None, **options):
        asked.update(options, folds=self.folds)
        return None, [({"numTrees": 50, "maxDepth": 5, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"}, 0.5)]

    monkeypatch.setattr(churn.ChurnPredictor, "grid_search", grid)
    monkeypatch.setattr(catalogue, "_customers", lambda spark, sf_dir: None)
    assert catalogue.queries()["grid_search"](spark, "").collect()[0].asDict() == {"trees": 50, "depth": 5, "least_rows": 1, "features": "all", "auc": 0.5}
    assert asked == {"folds": 5}
