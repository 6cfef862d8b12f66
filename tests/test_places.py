import pytest
from pyspark.sql import functions as F

from tallywick.ml import explain
from tallywick.plans import places


@pytest.fixture(scope="module")
def rows(spark):
    tied = F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(500)).cast("double"))
    group = F.when(F.col("id") < 40, "few").when(F.col("id") % 50 == 0, None).otherwise("most")
    return spark.range(20_000).select(F.col("id").alias("row_id"), group.alias("g"), F.when(F.col("id") % 91 == 0, None).otherwise(tied).alias("x"))


def test_ranks_equal_those_of_one_sort(rows):
    got = sorted((r.g or "", r.rank, r.x, r.row_id) for r in places.ranked(rows, "g", ["x", "row_id"]).collect())
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.g or "", r.x is not None, r.x or 0.0, r.row_id)):
        want.setdefault(r.g or "", []).append((r.x, r.row_id))
    assert got == [(g, k + 1, x, i) for g in sorted(want) for k, (x, i) in enumerate(want[g])]
    assert places.ranked(rows.limit(0), "g", ["x", "row_id"]).count() == 0


def test_a_hot_value_spreads_over_tasks(rows):
    spread = rows.where("g = 'most'").withColumn("x", F.lit(1.0)).repartitionByRange(4, "g", "x", "row_id")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)


@pytest.mark.parametrize("block", [50_000, 300, 1])
def test_rotation_is_the_row_before_in_hash_order(spark, monkeypatch, block):
    monkeypatch.setattr(places, "BLOCK_ROWS", block)
    small = spark.range(700).select(F.col("id").alias("row_id"), (F.col("id") / 7).alias("a"), F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("t"), "id")).alias("b"))
    got = {(r.row_id, r.k): r.given for r in places.rotated(small, "row_id", ["a", "b"], [3, 4], 700).collect()}
    for k, c in enumerate("ab"):
        order = small.select("row_id", F.col(c).cast("string").alias("v"), F.xxhash64("row_id", F.lit(3 + k)).alias("h")).orderBy("h", "row_id").collect()
        assert [got[r.row_id, k] for r in order] == [order[i - 1].v for i in range(len(order))]


def test_permutation_of_all_rows_one_row_and_none(spark, monkeypatch):
    monkeypatch.setattr(places, "BLOCK_ROWS", 200)
    df = spark.range(5000).select((F.col("id") % 97).cast("int").alias("a"), F.when(F.col("id") % 4 == 0, "p").otherwise("q").alias("kind"))
    score = lambda x: x.withColumn("score", 2.0 * F.col("a") + F.when(F.col("kind") == "p", 1.0).otherwise(0.0))
    got = explain.explain_permutation(df, score, ["a"], most=None)
    n, total = got.values.agg(F.count("*"), F.sum("shap_value")).first()
    assert n == 5000 and abs(total) < 1e-6
    assert abs(got.base_value - df.agg(F.avg(2.0 * F.col("a") + F.when(F.col("kind") == "p", 1.0).otherwise(0.0))).first()[0]) < 1e-9
    one = explain.explain_permutation(df.limit(1), score, ["a"], most=None)
    assert [r.shap_value for r in one.values.collect()] == [0.0]
    none = explain.explain_permutation(df.limit(0), score, ["a"], most=None)
    assert none.values.count() == 0 and none.base_value == 0.0


def test_beeswarm_of_many_rows(rows):
    values = rows.select("row_id", F.lit("f").alias("feature"), F.col("x").alias("value"), F.coalesce("x", F.lit(0.0)).alias("shap_value"))
    got = explain.Explanation(values, 0.0, ["f"]).beeswarm()
    assert got.columns == ["row_id", "feature", "value", "shap_value", "rank", "scaled"]
    assert got.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.min("scaled"), F.max("scaled")).first()[:] == (20_000, 1, 20_000, 0.0, 1.0)
