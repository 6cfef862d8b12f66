"""Newton's fit against the simplex search, and the number of its passes."""

import numpy as np
import pytest

from tallywick.operators import bgnbd


def drawn(n, seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(60, 700, n).astype(float)
    rate, gone = rng.gamma(1.2, 1 / 40, n), rng.beta(0.8, 2.5, n)
    x, tx = np.zeros(n), np.zeros(n)
    for k in range(n):
        at = 0.0
        while rng.random() > gone[k] or x[k] == 0 and at == 0:
            at += rng.exponential(1 / rate[k])
            if at > t[k]:
                break
            x[k], tx[k] = x[k] + 1, at
    return x, np.floor(tx), t


@pytest.mark.parametrize("seed", [1, 2])
def test_same_minimum_as_the_simplex(seed):
    x, tx, t = drawn(1500, seed)
    scale, weight = 10 / t.max(), np.ones(len(x))
    passes = []

    def losses(points):
        passes.append(len(points))
        return [bgnbd.bgnbd_loss(p, x, tx * scale, t * scale, weight) for p in points]

    got = bgnbd.newton(losses, np.zeros(4))
    want = bgnbd.simplex(lambda p: losses([p])[0], np.zeros(4), tolerance=1e-14)
    assert np.allclose(np.exp(got), np.exp(want), rtol=1e-4, atol=1e-6)
    assert sum(n > 1 for n in passes) < 60

    rng = np.random.default_rng(seed)
    some = x > 0
    m = rng.gamma(6 * x[some], 10 / x[some]) / rng.gamma(4, 0.25, some.sum())
    loss = lambda p: bgnbd.gamma_gamma_loss(p, x[some], m / m.mean(), weight[some])
    got = bgnbd.newton(lambda points: [loss(p) for p in points], np.array([1.0, 1.0, 0.5]))
    want = bgnbd.simplex(loss, np.array([1.0, 1.0, 0.5]), tolerance=1e-14)
    assert np.allclose(np.exp(got), np.exp(want), rtol=1e-4, atol=1e-6)


def test_losses_in_spark_are_those_of_the_driver(spark):
    x, tx, t = drawn(400, 3)
    weight = np.arange(400) % 5 + 1.0
    stats = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, tx, t, weight, strict=True)], "x double, tx double, t double, n double").repartition(3)
    points = [np.full(4, v) for v in (-0.5, 0.0, 0.3)]
    got = bgnbd._losses(stats, bgnbd.bgnbd_like, points)
    assert got == pytest.approx([bgnbd.bgnbd_loss(p, x, tx, t, weight) for p in points], rel=1e-12)


def test_a_loss_without_derivatives():
    found = bgnbd.newton(lambda points: [float("inf") if p[0] < -0.0005 else float(p[0] ** 2 + (p[1] - 1) ** 2) for p in points], np.zeros(2))
    assert np.allclose(found, [0, 1], atol=1e-3)
