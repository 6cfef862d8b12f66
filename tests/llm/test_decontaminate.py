import re

import numpy as np

from tallywick.llm import decontaminate as d

from .texts import ODD_TEXTS, documents


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    return re.sub(rb"[\x20\x09-\x0d]+", b" ", low).strip(b" ")


def least_distance(item, text):
    """Edit distance of item to the best substring of text, by the plain table."""
    row, at = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.append(i, np.minimum(row[:-1] + (np.frombuffer(text, np.uint8) != c), row[1:] + 1))
        row = np.minimum.accumulate(new - at) + at  # insertions from the left
    return int(row.min())


def test_normal_form():
    texts = ["", "  A b\t\nC ", "x", " ", "\n\n", "É  Z", "end "]
    raw = [t.encode() for t in texts]
    buf, at = d.normal(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert [buf[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain(t) for t in texts]


def test_bit_parallel_distance():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item, text = (bytes(rng.choice(list(b"abc"), n).tolist()) for n in (rng.integers(1, 90), rng.integers(0, 120)))
        assert d.edit_distance_within(item, text, 10**6)[0] == min(least_distance(item, text), len(item)) if text else True


def edited(rng, text, rate):
    out = list(text)
    for _ in range(int(rate * len(text))):
        p, op = rng.integers(len(out)), rng.integers(3)
        if op == 0:
            out[p] = chr(rng.integers(97, 123))
        elif op == 1:
            out.insert(p, chr(rng.integers(97, 123)))
        else:
            del out[p]
    return "".join(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    syllables = "an er th in ed ti on re st wh".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(n).capitalize() + "." for n in rng.integers(12, 45, 25)]
    docs, rates = [t for t in ODD_TEXTS if not t or len(t) < 6000], []
    for k in range(150):
        rate = (0, 0.03, 0.08, 0.15)[k % 4]
        docs.append(text(rng.integers(0, 80)) + " " + edited(rng, items[k % 25], rate).replace(" ", "\n " if k % 3 else " ") + " " + text(rng.integers(0, 80)))
        rates.append(rate)
    docs += [text(100) for _ in range(60)] + [items[3], items[4][5:], "tiny item", "a TINY  item here", "atinyitem"]
    all_items = [*items, "Tiny item", None, "", items[0]]
    got = d.contaminated(documents(spark, docs), spark.createDataFrame(list(enumerate(all_items)), "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id): r.distance for r in got}
    want = {}
    for i, t in enumerate(docs):
        for j, x in enumerate(all_items):
            item, body = plain(x), plain(t)
            if not item or not body:
                continue
            if len(item) < d.SHORT_BYTES:
                if item in body:
                    want[i, j] = 0
            elif (dist := least_distance(item, body)) <= int(0.2 * len(item) + 1e-9):
                want[i, j] = dist
    assert set(pairs) <= set(want)
    found = len(pairs) / len(want)
    assert found >= 0.93, found
    exact = {k for k, v in want.items() if v == 0}
    assert exact <= set(pairs) and all(pairs[k] == 0 for k in exact)
    assert np.mean([pairs[k] == want[k] for k in pairs]) > 0.97


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "some item of a benchmark")], "item_id long, text string")
    assert d.contaminated(documents(spark, []), items).collect() == []
    assert d.contaminated(documents(spark, ["some item of a benchmark"]), items.where("item_id = 2")).collect() == []
    assert [(r.doc_id, r.item_id, r.distance) for r in d.contaminated(documents(spark, ["Some item of a benchmark"] * 2, [5, 5]), items).collect()] == [(5, 1, 0)]
