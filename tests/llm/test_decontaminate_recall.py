"""Recall of operator 10 by item length and edit rate, up to the least similarity."""

import numpy as np

from tallywick.llm import decontaminate as d

from .test_decontaminate import edited, least_distance
from .texts import documents


def test_recall_by_length_and_rate(spark):
    rng = np.random.default_rng(11)
    syllables = "an er th in ed ti on re st wh".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    lengths, rates, each = (20, 60, 100, 200, 350, 600), (0.05, 0.1, 0.15, 0.2), 25
    items, docs, kinds = [], [], []
    for m in lengths:
        for _ in range(each):
            item = text(m)[: m - 1] + "x"
            for rate in rates:
                docs.append(text(25) + " " + edited(rng, item, rate) + " " + text(25))
                kinds.append((len(items), m, rate))
            items.append(item)
    found = d.contaminated(documents(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in found}
    for m in lengths:
        for rate in rates:
            own = [(k, n) for k, (n, size, r) in enumerate(kinds) if (size, r) == (m, rate)]
            assert all(least_distance(items[n].encode(), docs[k].encode()) <= int(0.2 * m + 1e-9) for k, n in own)
            share = np.mean([pair in got for pair in own])
            print(m, rate, share)
            assert share >= 0.88, (m, rate, share)
    for rate in rates:
        assert np.mean([(k, n) in got for k, (n, _, r) in enumerate(kinds) if r == rate]) >= 0.93, rate
    assert np.mean([(k, n) in got for k, (n, _, _) in enumerate(kinds)]) >= 0.95
