from pyspark.sql import functions as F

from tallywick.ml import churn, features


def customers(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    rows = spark.range(3000).select(F.col("id").cast("string").alias("customer"), (F.col("id") % 83).cast("double").alias("a"), noise.alias("b"))
    return rows.groupBy("customer").agg(F.max("a").alias("a"), F.max("b").alias("b")).withColumn("churned", (F.col("a") / 83 + F.col("b") > 1).cast("int"))


def test_fits_run_on_a_partition_a_core_not_on_those_of_a_shuffle(spark, monkeypatch):
    seen = []
    fit_kind = churn.ChurnPredictor.fit_kind
    monkeypatch.setattr(churn.ChurnPredictor, "fit_kind", lambda self, train, kind: seen.append(train.rdd.getNumPartitions()) or fit_kind(self, train, kind))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = churn.ChurnPredictor(trees=3).train(customers(spark), "churned", ["a", "b"], kind="rf")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert seen and seen[0] <= spark.sparkContext.defaultParallelism
    assert got.metrics["roc_auc"] > 0.9


def test_dealt_rows_are_all_there_and_large_tables_get_more_tasks(spark, monkeypatch):
    rows = customers(spark)
    monkeypatch.setattr(features, "TASK_ROWS", (50, 200))
    out = features.dealt(rows)
    assert out.rdd.getNumPartitions() == 15
    assert sorted(out.collect()) == sorted(rows.collect())


def test_boosted_trees_are_fitted_in_few_tasks(spark, monkeypatch):
    seen = []
    fit = churn.GBTClassifier.fit
    monkeypatch.setattr(churn.GBTClassifier, "fit", lambda self, x, *p: seen.append((x.rdd.getNumPartitions(), x.count())) or fit(self, x, *p))
    monkeypatch.setattr(features, "TASK_ROWS", (500, 1000))
    rows = features.dealt(customers(spark))
    got = churn.ChurnPredictor(trees=3).train(rows, "churned", ["a", "b"], kind="gb")
    monkeypatch.setattr(features, "PASS_ROWS", 1000)
    churn.ChurnPredictor(trees=3).train(rows, "churned", ["a", "b"], kind="gb")
    assert [parts for parts, _ in seen] == [1, 3]
    assert seen[0][1] == seen[1][1] > 2000
    assert got.metrics["roc_auc"] > 0.9


def test_a_stack_fits_boosted_trees_and_perceptrons_in_few_tasks_and_each_base_on_all_rows(spark, monkeypatch):
    seen = {}
    for c in (churn.RandomForestClassifier, churn.GBTClassifier, churn.MultilayerPerceptronClassifier):
        monkeypatch.setattr(c, "fit", lambda self, x, *p, fit=c.fit: seen.setdefault(type(self).__name__, []).append((x.rdd.getNumPartitions(), x.count())) or fit(self, x, *p))
    monkeypatch.setattr(features, "TASK_ROWS", (500, 1000))
    got = churn.ChurnPredictor(trees=2, folds=2).train(features.dealt(customers(spark)), "churned", ["a", "b"], kind="stacking")
    whole = {max(n for _, n in fits) for fits in seen.values()}
    assert len(seen) == 3 and len(whole) == 1 and whole.pop() > 2000
    assert all(len(fits) == 3 and sum(n for _, n in fits) == 2 * max(n for _, n in fits) for fits in seen.values())
    assert {p for name in ("GBTClassifier", "MultilayerPerceptronClassifier") for p, _ in seen[name]} == {1}
    assert got.metrics["roc_auc"] > 0.9


def test_starts_of_k_means_run_side_by_side_and_the_best_is_kept(spark, monkeypatch):
    from threading import Barrier

    from pyspark.ml.clustering import KMeans
    from tallywick.ml.cluster import STARTS_AT_ONCE, ClusteringEngine

    together, fit, costs = Barrier(STARTS_AT_ONCE, timeout=30), KMeans.fit, []

    def fitted(self, x, *p):
        together.wait()
        model = fit(self, x, *p)
        costs.append(model.summary.trainingCost)
        return model

    monkeypatch.setattr(KMeans, "fit", fitted)
    x = features.vectors(customers(spark).where("a < 20"), ["a", "b"])
    _, centres, cost = ClusteringEngine(n_init=STARTS_AT_ONCE).kmeans(x, 3)
    assert len(centres) == 3 and len(costs) == STARTS_AT_ONCE and cost == min(costs)


def test_the_registered_stack_has_production_parameters(spark, monkeypatch):
    """50 trees and rounds in each base model, scores of 5 folds, all rows."""
    from tallywick.plans import catalogue

    seen = []
    for c in (churn.RandomForestClassifier, churn.GBTClassifier, churn.MultilayerPerceptronClassifier):
        size = lambda e: e.getNumTrees() if isinstance(e, churn.RandomForestClassifier) else e.getMaxIter()
        monkeypatch.setattr(c, "fit", lambda self, x, *p, size=size: seen.append((type(self).__name__, size(self))) or churn.LogisticRegression().fit(x))
    rows = customers(spark).where("a < 40")
    monkeypatch.setattr(catalogue, "_customers", lambda spark, sf_dir: rows.withColumnRenamed("customer", "customer_id").withColumns({c: rows.a + k * rows.b for k, c in enumerate(catalogue.CHURN_FEATURES)}))
    assert catalogue.queries()["stacking_fit"](spark, "").count() == rows.count() > 1000
    assert sorted(seen) == sorted([("RandomForestClassifier", 50), ("GBTClassifier", 50), ("MultilayerPerceptronClassifier", 100)] * 6)
