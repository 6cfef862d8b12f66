import numpy as np

from tallywick.ml import explain


def test_a_leaf_is_worked_out_once_a_pattern_not_once_a_row(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    leaves = [explain.Leaf(float(rng.normal()), {int(f): (-float("inf"), float(rng.normal()), float(rng.uniform(0.2, 0.8))) for f in rng.choice(4, d, replace=False)}) for d in (0, 1, 2, 3, 4)]
    monkeypatch.setattr(explain, "TABLED", -1)
    plain = explain.leaf_effects(leaves, x)
    monkeypatch.undo()
    widths = []
    kept = explain.pattern_effects
    monkeypatch.setattr(explain, "pattern_effects", lambda leaf, rows: widths.append(rows.shape[1]) or kept(leaf, rows))
    assert np.allclose(explain.leaf_effects(leaves, x), plain, atol=1e-12)
    assert widths == [1, 2, 4, 8, 16]
