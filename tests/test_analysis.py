import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywick.operators import bgnbd, clv, cohorts, lists, quality, rollup, scoring, segments
from tallywick.sources.sample import generate_orders

FEW = [("kim", "2023-05-02", 30.0), ("lou", "2023-05-31", 210.0), ("max", "2023-06-05", 75.0), ("kim", "2023-06-20", 45.5), ("max", "2023-06-25", 15.0), ("ned", "2023-06-30", 8.0), ("kim", "2023-08-01", 24.5)]
SCHEMA = "customer_id string, order_date string, amount double"


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame(FEW, SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    return generate_orders(spark, 300, seed=7).select("customer_id", "order_date", "amount").cache()


def test_values_of_a_few_customers(few):
    got = segments.compute_rfm(few, reference_date=datetime(2023, 9, 1))
    found = {r.customer_id: (r.recency_days, r.frequency, r.monetary) for r in got.table.collect()}
    assert found == {"kim": (31, 3, 100.0), "lou": (93, 1, 210.0), "max": (68, 2, 90.0), "ned": (63, 1, 8.0)}
    # fewer customers than bins: everyone gets the middle score
    assert got.table.where("r_score <> 3 or f_score <> 3 or m_score <> 3").isEmpty()
    assert segments.compute_rfm(few).reference == datetime(2023, 8, 2)


def test_contract_errors(spark, few):
    for compute in (segments.compute_rfm, cohorts.compute_cohorts, clv.compute_clv):
        with pytest.raises(ValueError, match="empty"):
            compute(few.limit(0))
        with pytest.raises(KeyError):
            compute(few.drop("amount"))
    with pytest.raises(ValueError):
        segments.compute_rfm(few, n_segments=1)


def test_scores_equal_quantile_cut(spark):
    for n in (5, 6, 7, 11, 24, 37, 100):
        for bins in (3, 4, 5, 6, 7, 10):
            if n < bins:
                continue
            edges = np.array(scoring.interior_edges(n, bins))
            got = 1 + (edges[None] < np.arange(1, n + 1)[:, None]).sum(axis=1)
            assert (got == pd.qcut(np.arange(1, n + 1), bins, labels=False) + 1).all(), (n, bins)


def test_rank_without_a_single_task(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(f"c{i:04d}", int(v)) for i, v in enumerate(rng.integers(0, 20, 900))], "customer_id string, v long").repartition(7)
    plain = {r.customer_id: r.s for r in scoring.with_score(rows, "v", "s").collect()}
    monkeypatch.setattr(scoring, "PART_ROWS", 100)
    assert {r.customer_id: r.s for r in scoring.with_score(rows, "v", "s").collect()} == plain


def test_rules(spark):
    triples = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    df = spark.createDataFrame(triples, "r int, f int, m int").withColumn("s", segments.segment_of(F.col("r"), F.col("f"), F.col("m")))
    found = {(x.r, x.f, x.m): x.s for x in df.collect()}
    assert [found[t] for t in ((5, 5, 5), (1, 4, 4), (1, 3, 3), (1, 1, 1))] == ["Champions", "Cant Lose Them", "At Risk", "Lost"]
    count = pd.Series(list(found.values())).value_counts().to_dict()
    assert count == {"Others": 40, "Loyal Customers": 19, "Need Attention": 13, "Potential Loyalists": 12, "Champions": 8, "New Customers": 8, "Cant Lose Them": 7, "At Risk": 7, "Promising": 4, "Lost": 4, "About To Sleep": 3}


def test_cohorts_of_a_few_customers(few):
    got = cohorts.compute_cohorts(few)
    cells = {(r.cohort, r.month_offset): (r.active, r.retention) for r in got.long.collect()}
    assert cells == {("2023-05", 0): (2, 1.0), ("2023-05", 1): (1, 0.5), ("2023-05", 3): (1, 0.5), ("2023-06", 0): (2, 1.0)}
    assert (got.max_offset, got.n_cohorts) == (3, 2)
    assert {r.month_offset: r.retention for r in got.curve.collect() if r.retention is not None} == {0: 1.0, 1: 0.5, 3: 0.5}
    wide = {r.cohort: [r[str(k)] for k in range(4)] for r in got.counts.collect()}
    assert wide == {"2023-05": [2, 1, None, 1], "2023-06": [2, None, None, None]}


def test_sample_properties(spark, sample):
    again = generate_orders(spark, 300, seed=7).select("customer_id", "order_date", "amount")
    assert sample.exceptAll(again).isEmpty()
    rfm = segments.compute_rfm(sample)
    t = rfm.table.toPandas()
    assert t.customer_id.is_unique and (t.rfm_score == 100 * t.r_score + 10 * t.f_score + t.m_score).all()
    assert t[["r_score", "f_score", "m_score"]].isin(range(1, 6)).all().all() and (t.recency_days >= 0).all()
    s = rfm.segment_summary.toPandas()
    assert s.customers.sum() == len(t) and abs(s.pct_revenue.sum() - 100) < 1 and s.total_revenue.is_monotonic_decreasing
    c = cohorts.compute_cohorts(sample).long.toPandas()
    assert c.retention.between(0, 1).all() and (c[c.month_offset == 0].retention == 1).all()
    short, long = (clv.compute_clv(sample, horizon_months=h, method="heuristic") for h in (3, 24))
    assert 0 <= short.total_clv <= long.total_clv
    assert set(short.table.columns) == set(clv.OUTPUT) and short.summary["customers"] == len(t)
    with pytest.raises(ValueError):
        clv.compute_clv(sample, method="magic")


def test_recent_customers_are_worth_more(spark):
    rows = [(who, f"{year}-{month:02d}-10", 25.0) for who, year in (("still", 2022), ("gone", 2020)) for month in (2, 4, 7, 11)] + [("other", "2022-12-20", 9.0)]
    value = clv.compute_clv(spark.createDataFrame(rows, SCHEMA)).table
    got = {r.customer_id: r.predicted_clv for r in value.collect()}
    assert got["still"] > got["gone"] >= 0


def test_lists(sample):
    rfm, value = segments.compute_rfm(sample), clv.compute_clv(sample, method="heuristic")
    got = lists.build_customer_lists(rfm, value, churn_top=5, high_value_top=3)
    every, churn, best = (x.toPandas() for x in (got.customers, got.churn_risk, got.high_value))
    assert list(every.columns) == lists.LIST_COLUMNS and len(every) == rfm.n_customers
    assert len(churn) == 5 and len(best) == 3
    assert churn.segment.isin(lists.CHURN_SEGMENTS).all() and best.segment.isin(lists.HIGH_VALUE_SEGMENTS).all()
    assert churn.predicted_clv.is_monotonic_decreasing and best.predicted_clv.is_monotonic_decreasing
    assert every.churn_score.between(0, 1).all() and (every.recommended_action != "").all()


def test_findings(spark):
    def codes(rows):
        return {f.code for f in quality.check_orders(spark.createDataFrame(rows, SCHEMA)).findings}

    late = (datetime.now() + timedelta(days=9)).strftime("%Y-%m-%d")
    assert "future_dates" in codes([("p", "2022-02-02", 4.0), ("q", late, 4.0)])
    assert "short_history" in codes([("p", "2022-02-02", 4.0), ("p", "2022-02-20", 6.0)])
    assert codes([("p", "2022-02-02", 4.0), ("q", "2022-07-08", 3.0), ("p", "2022-02-02", 4.0)]) == {"duplicate_rows"}
    assert "mostly_one_time" in codes([(f"p{k}", f"2022-0{1 + k % 7}-15", 2.0) for k in range(8)])
    assert quality.check_orders(spark.createDataFrame([], SCHEMA)).n_rows == 0


def test_special_functions():
    x = np.array([0.1, 0.5, 1.0, 2.0, 3.7, 10.0, 123.4])
    assert np.allclose(bgnbd.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    assert np.isclose(bgnbd.hyp2f1(1.0, 1.0, 2.0, 0.5), -math.log(0.5) / 0.5)
    assert np.allclose(bgnbd.simplex(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, np.zeros(2)), [1, -2], atol=1e-3)


def test_model_recovers_a_simulated_store(spark):
    rng = np.random.default_rng(0)
    n, horizon = 3000, 300.0
    rate, drop = rng.gamma(1.2, 1 / 20.0, n), rng.beta(0.8, 2.5, n)
    x, tx = np.zeros(n), np.zeros(n)
    for i in range(n):
        t = rng.exponential(1 / rate[i])
        while t < horizon:
            x[i] += 1
            tx[i] = t
            if rng.random() < drop[i]:
                break
            t += rng.exponential(1 / rate[i])
    params = bgnbd.fit_bgnbd(x, tx, np.full(n, horizon), np.ones(n))
    assert np.isfinite(params).all()
    ahead = bgnbd.expected_purchases(params, x, tx, np.full(n, horizon), 100.0)
    assert ahead[(x > 3) & (tx > 280)].mean() > ahead[(x > 3) & (tx < 100)].mean()
    assert 0.5 < params[0] < 2.5
    orders = generate_orders(spark, 200, seed=3).select("customer_id", "order_date", "amount")
    got = clv.compute_clv(orders, method="auto")
    assert got.method == "bgnbd_gamma_gamma" and got.total_clv > 0
    assert got.table.where("predicted_clv < 0 or predicted_clv is null").isEmpty()


def test_rollup_at_day_boundaries(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 3, 14, 10), 1.0)], "customer_id string, order_date timestamp_ntz, amount double")
    got = rollup.rfm_base(rows, F.lit(datetime(2024, 3, 16, 9)).cast("timestamp_ntz")).first()
    assert got.recency_days == 1  # floor of elapsed time, not calendar days
