"""The fit sees every customer, however many groups there are."""

from tallywick.operators import bgnbd, clv
from tallywick.sources.sample import generate_orders


def test_fit_in_spark_equals_fit_on_the_driver(spark, monkeypatch):
    orders = generate_orders(spark, 200, seed=3).select("customer_id", "order_date", "amount")
    inputs = clv.clv_inputs(orders).cache()
    search = bgnbd.simplex
    monkeypatch.setattr(bgnbd, "simplex", lambda f, start: search(f, start, steps=12))
    got = {}
    for most in (50_000, 10):
        monkeypatch.setattr(bgnbd, "FIT_ROWS", most)
        got[most] = {r.customer_id: r._clv for r in bgnbd.fit_and_predict(inputs, 12, 0.01).collect()}
    assert len(got[10]) == len(got[50_000]) and sum(got[10].values()) > 0
    assert all(abs(got[10][c] - v) <= 1e-6 * max(1.0, v) for c, v in got[50_000].items())
