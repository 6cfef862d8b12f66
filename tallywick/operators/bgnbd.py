"""BG/NBD and Gamma-Gamma by maximum likelihood.

Spark reduces customers to counted sufficient statistics, all of which are fitted
by Newton steps.  Up to ``FIT_ROWS`` of them come to the driver; more stay in
Spark.  A step needs two passes over them, each an aggregation of the losses of
all points that it asks for (those around the current one, then those along the
step), of which one number each reaches the driver.  Every customer is scored in
an Arrow function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import materialised

#: Groups over which the fit goes from the driver to Spark, which sees the same groups.
PENALTY, FIT_ROWS = 0.01, 50_000


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive x: shifted up, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift = np.where(small, shift + np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def hyp2f1(a, b, c, z, terms: int = 2000) -> np.ndarray:
    """Gauss' series for 0 <= z < 1."""
    a, b, c, z = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, c, z)))
    total, term = np.ones(z.shape), np.ones(z.shape)
    for k in range(terms):
        term = term * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        total = total + term
        if np.all(np.abs(term) <= 1e-12 * np.abs(total)):
            break
    return total


def simplex(f, start: np.ndarray, steps: int = 2000, tolerance: float = 1e-9) -> np.ndarray:
    """Nelder-Mead minimum."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + 0.3 * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        centre = np.mean(points[:-1], axis=0)
        mirrored = centre + (centre - points[-1])
        v = f(mirrored)
        if v < values[0]:
            further = centre + 2 * (centre - points[-1])
            w = f(further)
            points[-1], values[-1] = (further, w) if w < v else (mirrored, v)
        elif v < values[-2]:
            points[-1], values[-1] = mirrored, v
        else:
            nearer = centre + 0.5 * ((mirrored if v < values[-1] else points[-1]) - centre)
            w = f(nearer)
            if w < min(v, values[-1]):
                points[-1], values[-1] = nearer, w
            else:
                points = [points[0], *[points[0] + 0.5 * (p - points[0]) for p in points[1:]]]
                values = [values[0], *[f(p) for p in points[1:]]]
    return points[int(np.argmin(values))]


#: Distance of the points from which derivatives are taken, and lengths of steps tried.
NEAR, LENGTHS = 1e-3, (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 2.0, 4.0)


def newton(losses, start: np.ndarray, steps: int = 25) -> np.ndarray:
    """Minimum of a smooth loss; ``losses(points)`` gives those of many points in
    one pass, of which at most two a step are made.  A simplex search takes over
    where the loss has no finite derivatives."""
    n, x = len(start), np.array(start, float)
    unit = NEAR * np.eye(n)
    pairs = [(i, j) for i in range(n) for j in range(i)]
    for _ in range(steps):
        around = [x, *(x + u for u in unit), *(x - u for u in unit), *(x + unit[i] + unit[j] for i, j in pairs), *(x - unit[i] - unit[j] for i, j in pairs)]
        f = np.asarray(losses(around), float)
        if not np.isfinite(f).all():
            return simplex(lambda p: float(losses([p])[0]), start)
        here, up, down, both, none = f[0], f[1 : n + 1], f[n + 1 : 2 * n + 1], f[2 * n + 1 : 2 * n + 1 + len(pairs)], f[2 * n + 1 + len(pairs) :]
        slope = (up - down) / (2 * NEAR)
        bend = np.diag((up + down - 2 * here) / NEAR**2)
        for k, (i, j) in enumerate(pairs):
            bend[i, j] = bend[j, i] = (both[k] + none[k] - up[i] - down[i] - up[j] - down[j] + 2 * here) / (2 * NEAR**2)
        values, axes = np.linalg.eigh(bend)
        step = -axes @ ((axes.T @ slope) / np.maximum(np.abs(values), 1e-6))
        step *= min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-300))
        if np.abs(step).max() < 1e-7:
            break
        along = np.asarray(losses([x + t * step for t in LENGTHS]), float)
        best = int(np.nanargmin(along))
        if not along[best] < here - 1e-15 * abs(here):
            break
        x = x + LENGTHS[best] * step
    return x


def _params(log_params: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(log_params, -12, 12))


def _penalty(log_params: np.ndarray) -> float:
    return PENALTY * np.sum(np.exp(2 * np.clip(log_params, -12, 12)))


def bgnbd_like(log_params: np.ndarray, x, tx, t) -> np.ndarray:
    r, alpha, a, b = _params(log_params)
    base = lgamma(r + x) - lgamma(r) + r * np.log(alpha) + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
    never = -(r + x) * np.log(alpha + t)
    dead = np.where(x > 0, np.log(a) - np.log(np.maximum(b + x - 1, 1e-12)) - (r + x) * np.log(alpha + tx), -np.inf)
    return base + np.logaddexp(never, dead)


def bgnbd_loss(log_params: np.ndarray, x, tx, t, weight) -> float:
    return float(-(weight @ bgnbd_like(log_params, x, tx, t)) / weight.sum() + _penalty(log_params))


def gamma_gamma_like(log_params: np.ndarray, x, m) -> np.ndarray:
    p, q, v = _params(log_params)
    return lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * np.log(v) + (p * x - 1) * np.log(m) + p * x * np.log(x) - (p * x + q) * np.log(x * m + v)


def gamma_gamma_loss(log_params: np.ndarray, x, m, weight) -> float:
    return float(-(weight @ gamma_gamma_like(log_params, x, m)) / weight.sum() + _penalty(log_params))


def _bgnbd_search(losses, most: float) -> np.ndarray:
    """(r, alpha, a, b) for ``losses(points, scale)``; time is scaled to a maximum of 10."""
    scale = 10.0 / max(most, 1.0)
    best = _params(newton(lambda points: losses(points, scale), np.zeros(4)))
    best[1] /= scale
    return best


def _gamma_gamma_search(losses, mean: float) -> np.ndarray:
    best = _params(newton(lambda points: losses(points, mean), np.array([1.0, 1.0, 0.5])))
    best[2] *= mean
    return best


def fit_bgnbd(x, tx, t, weight) -> np.ndarray:
    """(r, alpha, a, b); time is scaled to a maximum of 10 while fitting."""
    return _bgnbd_search(lambda points, scale: [bgnbd_loss(p, x, tx * scale, t * scale, weight) for p in points], float(np.max(t)))


def fit_gamma_gamma(x, m, weight=None) -> np.ndarray:
    weight = np.ones(len(x)) if weight is None else weight
    return _gamma_gamma_search(lambda points, scale: [gamma_gamma_loss(p, x, m / scale, weight) for p in points], float(weight @ m / weight.sum()))


def _losses(stats: DataFrame, like, points: list[np.ndarray]) -> list[float]:
    """The loss of every point, from one pass over the groups of ``stats``, each as
    often as its last column says."""

    def sums(batches):
        total, n = np.zeros(len(points)), 0.0
        for b in batches:
            *columns, weight = (c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns)
            if len(weight):
                n += float(weight.sum())
                total += [float(weight @ like(p, *columns)) for p in points]
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(points)), "total": total, "n": np.full(len(points), n)})

    found = stats.mapInArrow(sums, "k long, total double, n double").groupBy("k").agg(F.sum("total"), F.sum("n")).collect()
    return [-t / n + _penalty(points[k]) for k, t, n in sorted(map(tuple, found))]


def expected_purchases(params, x, tx, t, ahead) -> np.ndarray:
    """Purchases in (t, t + ahead] given the history."""
    r, alpha, a, b = params
    a = a if abs(a - 1) > 1e-6 else a + 1e-6
    z = ahead / (alpha + t + ahead)
    ratio = (a + b + x - 1) / (a - 1)
    growth = 1 - ((alpha + t) / (alpha + t + ahead)) ** (r + x) * hyp2f1(r + x, b + x, a + b + x - 1, z)
    alive = 1 + np.where(x > 0, a / np.maximum(b + x - 1, 1e-12) * ((alpha + t) / (alpha + tx)) ** (r + x), 0.0)
    return np.maximum(ratio * growth / alive, 0)


def expected_value(params, x, m) -> np.ndarray:
    p, q, v = params
    q = q if abs(p * 1 + q - 1) > 1e-9 else q + 1e-6
    return p * (v + x * m) / (p * x + q - 1)


def lifetime_value(bg, gg, x, tx, t, m, months: int, rate: float) -> np.ndarray:
    value, before, out = expected_value(gg, x, m), np.zeros(len(x)), np.zeros(len(x))
    for i in range(1, months + 1):
        now = expected_purchases(bg, x, tx, t, 30.0 * i)
        out += value * (now - before) / (1 + rate) ** i
        before = now
    return np.maximum(out, 0)


def _few(stats: DataFrame) -> list[np.ndarray] | None:
    """The columns of ``stats`` in an order of their own, None if it has over ``FIT_ROWS`` rows."""
    rows = stats.limit(FIT_ROWS + 1).toPandas()
    if len(rows) > FIT_ROWS:
        return None
    rows = rows.astype(float).sort_values(list(rows.columns))
    return [rows[c].to_numpy() for c in rows.columns]


def fit_and_predict(inputs: DataFrame, horizon_months: int, rate: float) -> DataFrame:
    """Adds _clv to the table of :func:`~tallywick.operators.clv.clv_inputs`."""
    stats = inputs.groupBy("frequency", "recency", "T").count()
    near = _few(stats)
    if near is not None:
        bg = fit_bgnbd(*near)
    else:
        stats = materialised(stats)
        most = float(stats.agg(F.max("T")).first()[0])
        bg = _bgnbd_search(lambda points, scale: _losses(stats, lambda p, x, tx, t: bgnbd_like(p, x, tx * scale, t * scale), points), most)
    repeat = inputs.where("frequency > 0 and monetary_value > 0").groupBy("frequency", "monetary_value").count()
    near = _few(repeat)
    if near is not None:
        if not len(near[0]):
            raise ValueError("no repeat buyer has a positive value")
        gg = fit_gamma_gamma(*near)
    else:
        repeat = materialised(repeat)
        mean = float(repeat.agg(F.sum(F.col("monetary_value") * F.col("count")) / F.sum("count")).first()[0])
        gg = _gamma_gamma_search(lambda points, scale: _losses(repeat, lambda p, x, m: gamma_gamma_like(p, x, m / scale), points), mean)
    if not (np.isfinite(bg).all() and np.isfinite(gg).all()):
        raise ValueError("the fit did not converge")

    def score(batches):
        for b in batches:
            x, tx, t, m = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("frequency", "recency", "T", "monetary_value"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lifetime_value(bg, gg, x, tx, t, m, horizon_months, rate))], [*b.schema.names, "_clv"])

    return inputs.mapInArrow(score, T.StructType([*inputs.schema.fields, T.StructField("_clv", T.DoubleType())]))
