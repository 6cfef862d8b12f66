import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywick.operators import scoring
from tallywick.plans import selection


def test_percentiles_of_more_values_than_may_be_gathered(spark, monkeypatch):
    monkeypatch.setattr(selection, "GATHER", 50)
    rng = np.random.default_rng(3)
    n = 20_000
    x = rng.normal(size=n) * 10.0 ** rng.integers(-6, 6, n)
    y = np.where(rng.random(n) < 0.4, 7.25, rng.random(n) * 1e9)  # two rows in five are equal
    rows = [(float(a) if k % 9 else None, float("nan") if k % 7 == 0 else float(b), None, int(k % 3)) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "x double, y double, empty double, few int").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = selection.percentiles(df, {"x": shares, "y": shares, "empty": [0.5], "few": [0.5, 0.95]})
    keep = np.arange(n)
    assert got["x"] == pytest.approx(np.quantile(x[keep % 9 != 0], shares), rel=1e-12)
    assert got["y"] == pytest.approx(np.quantile(y[keep % 7 != 0], shares), rel=1e-12)
    assert got["empty"] == [None] and got["few"] == [1.0, 2.0]


def test_extreme_numbers(spark, monkeypatch):
    monkeypatch.setattr(selection, "GATHER", 1)
    values = [-1.7e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.7e308, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    chosen = selection.Selector(df, ["x"])
    got = [p.value for p in chosen.places([("x", k) for k in range(len(values))])]
    assert got == sorted(values)
    longs = [-(1 << 63), -1, 0, 1, (1 << 63) - 1, 5, 5, 5]
    df = spark.createDataFrame([(v,) for v in longs], "x long")
    places = selection.Selector(df, ["x"]).places([("x", k) for k in range(len(longs))])
    assert [p.value for p in places] == sorted(longs)
    assert [(p.less, p.equal) for p in places if p.value == 5] == [(4, 3)] * 3
    with pytest.raises(ValueError):
        selection.Selector(df, ["x"]).places([("x", 8)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double")
    assert selection.percentiles(df, {"x": [0.5]}) == {"x": [None]}


def test_texts_by_rank(spark, monkeypatch):
    monkeypatch.setattr(selection, "GATHER", 3)
    texts = sorted({f"customer-{k % 400:05d}-é{'x' * (k % 11)}" for k in range(900)} | {"", "a", "customer", "customer-00001-éxx\x01"}, key=str.encode)
    df = spark.createDataFrame([(t, 1.5) for t in texts] + [("z", None), ("zz", None), ("zzz", 2.0)], "t string, v double").repartition(3)
    ranks = [0, 1, 2, 17, len(texts) // 2, len(texts) - 1]
    got = selection.nth_texts(df, "t", ["v"], [("v", 1.5, r, len(texts)) for r in ranks] + [("v", None, 1, 2)])
    assert got == [texts[r] for r in ranks] + ["zz"]


@pytest.mark.parametrize("gather", [2, 1 << 16])
def test_scores_equal_ranks(spark, monkeypatch, gather):
    monkeypatch.setattr(scoring, "PART_ROWS", gather)
    rng = np.random.default_rng(4)
    rows = [(f"c{k:04d}", int(rng.integers(4)), float(rng.normal()), None if k % 5 == 0 else float(k % 3)) for k in range(333)]
    df = spark.createDataFrame(rows, "customer_id string, a long, b double, c double").withColumn("d", F.col("b").cast("decimal(12,2)")).repartition(4)
    wanted = [("a", "sa", True), ("b", "sb", False), ("c", "sc", True), ("d", "sd", True)]
    got = {r.customer_id: r for r in scoring.with_scores(df, wanted).collect()}
    assert len(got) == len(rows)
    full = [(r.customer_id, r.a, r.b, r.c, r.d) for r in got.values()]
    for k, (_, out, up) in enumerate(wanted, 1):
        ranked = sorted(full, key=lambda r: (r[k] is not None, r[k] if r[k] is not None else 0, r[0]))
        for rank, r in enumerate(ranked, 1):
            score = 1 + sum(rank > e for e in scoring.interior_edges(len(rows), 5))
            assert got[r[0]][out] == (score if up else 6 - score), (out, r)


def test_scores_keep_no_checkpoint(spark):
    df = spark.createDataFrame([(f"c{k}", k) for k in range(50)], "customer_id string, v long")
    out = scoring.with_score(df, "v", "s")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
