import math

import numpy as np

from tallywick.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", None) for i, v, g in rows], SCHEMA)


def brute(rows, positives=5, negatives=5, low=80, high=100):
    """All rows against all anchors; equal rows are told apart by their place."""
    ready = []
    for i, v, g in rows:
        if v is not None and g is not None and all(x is not None and math.isfinite(x) for x in v):
            ready.append((i, [math.floor(256 * x) for x in v], (g + 1) % 10 if i is not None and i % 7 == 0 else g))
    out = []
    for k, (i, v, g) in enumerate(ready):
        if i is None or i % 100:
            continue
        score = lambda r, v=v: sum(a * b for a, b in zip(v, r[1], strict=False))
        first = lambda rs: sorted(((-score(r), r[0] is None, r[0] or 0) for r in rs))
        for s, null, p in first(r for j, r in enumerate(ready) if j != k and r[2] == g)[:positives]:
            near = first(r for r in ready if r[2] != g and low * -s <= 100 * score(r) <= high * -s)[:negatives]
            out += [(i, None if null else p, n + 1, None if z else q, -s, -t) for n, (t, z, q) in enumerate(near)]
    return out


def same(frame, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=key) == sorted(want, key=key)


def clustered(rng, n, dims=8):
    centres = rng.normal(size=(3, dims))
    return [(int(i), (centres[rng.integers(3)] + rng.normal(scale=0.4, size=dims)).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(n)]


def test_equals_brute_force(spark):
    rows = clustered(np.random.default_rng(1), 1500)
    want = brute(rows)
    assert len(want) > 200
    same(hard_negatives.hard_negatives(table(spark, rows).repartition(5)), want)


def test_anchors_in_passes_and_blocks(spark):
    rows = clustered(np.random.default_rng(2), 2500, 4)
    frame = table(spark, rows).repartition(3)
    same(hard_negatives.hard_negatives(frame, pass_bytes=256), brute(rows))
    same(hard_negatives.hard_negatives(frame, positives=2, negatives=3, low=50, high=90), brute(rows, 2, 3, 50, 90))


def test_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    few = [[1.0, 0.5], [0.9, 0.5], [1.0, 0.5], [0.25, 1.0]]
    rows = [(int(i), few[rng.integers(4)], int(rng.integers(3))) for i in range(900)]
    rows += [(100, [1.0, 0.5], 1)] * 3 + [(200, [1.0, 0.5], 2), (200, [0.9, 0.5], 2), (200, [0.9, 0.5], 1)] + [(7, few[0], 1)] * 40
    rows += [(-300, few[0], 2), (-7, few[1], 9), (None, few[0], 1), (None, few[1], 2)]
    same(hard_negatives.hard_negatives(table(spark, rows).repartition(4)), brute(rows))


def test_nulls_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = clustered(rng, 400, 3)
    rows += [
        (500, None, 1), (600, [1.0, None, 0.0], 1), (700, [float("nan"), 1.0, 1.0], 1), (800, [float("inf"), 1.0, 1.0], 1),
        (900, [1.0, 1.0, 1.0], None), (1000, [], 1), (1100, [1.0], 1), (1200, [1.0, 1.0, 1.0, 1.0, 9.0], 1), (None, [0.5, 0.5, 0.5], 3),
        (1300, [-0.001, -0.5, 0.0], 2),
    ]
    same(hard_negatives.hard_negatives(table(spark, rows).repartition(2)), brute(rows))


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.integers(1, 1 << 24, 3) + rng.random(3)).tolist(), int(rng.integers(2))) for i in range(250)]
    rows += [(1000, [3e5, 2.0**24 + 1, 2.0**24 + 1], 0), (1001, [3e5, 2.0**24 + 1, 2.0**24 + 1], 0), (1002, [3e5, 2.0**24 + 1, 2.0**24], 1)]
    want = brute(rows)
    assert max(r[4] for r in want) > 1 << 63
    same(hard_negatives.hard_negatives(table(spark, rows)), [(*r[:4], *(min(s, (1 << 63) - 1) for s in r[4:])) for r in want])


def test_empty_tables(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, None, None)], [(100, [1.0], 1), (1, [1.0], 1)]):
        got = hard_negatives.hard_negatives(table(spark, rows))
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and got.collect() == []
