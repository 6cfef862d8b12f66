import hashlib
import random
import re

from pyspark.sql import functions as F

from tallywick.llm import merkle

from .texts import documents


def check(spark, texts, ids):
    got = [r.asDict() for r in merkle.fingerprint_edits(documents(spark, texts, ids)).collect()]
    rows = sorted(((i, t or "") for i, t in zip(ids, texts, strict=True) if i is not None))
    want = []
    for i, t in zip(ids, texts, strict=True):
        t = t or ""
        later = [r for r in rows if i is not None and r[0] > i]
        following = (later or rows or [(0, t)])[0][1]
        k = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()))
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted([(g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got], key=key) == sorted(want, key=key)
    assert all(0 <= g[c] <= 1 for g in got for c in ("near_edited", "near_next"))
    return got


def test_edits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa 日本 🙂".split()
    texts = ["\n".join(" ".join(words[(i * j + k) % len(words)] for k in range(7)) for j in range(i % 9)) for i in range(40)]
    texts[5], texts[6], texts[7] = None, "", "x" * 3000
    ids = [i * i * 3 - 50 for i in range(40)]
    check(spark, texts, ids)
    check(spark, texts + ["repeat", "repeat", "other", "lost"], [*ids, 7, 7, 7, None])
    check(spark, ["only one, its own next"], [5])
    assert merkle.fingerprint_edits(documents(spark, [])).collect() == []


def test_equal_texts_and_likeness(spark):
    base = "\n".join(f"paragraph {i} with some words of its own" for i in range(60))
    texts = [base, base, base[:-300] + "y" * 300, "quite different\n" * 50, None, ""]
    got = sorted((r.doc_id, r.fingerprint) for r in merkle.fingerprints(documents(spark, texts)).collect())
    prints = [f for _, f in got]
    assert prints[0] == prints[1] and prints[4] == prints[5] and len(set(prints)) == 4
    pairs = spark.createDataFrame([(prints[a], prints[b]) for a, b in ((0, 1), (0, 2), (0, 3), (4, 5), (0, 4))], "a string, b string")
    same, near, far, empty, none = [r.x for r in pairs.select(merkle.likeness("a", "b").alias("x")).collect()]
    assert (same, far, empty, none) == (1.0, 0.0, 1.0, 0.0) and 0.7 < near < 1


def pieces(text):
    return re.findall(r"[^\n]{1,48}\n?|\n", text)


def plain_tree(text):
    """(root, leaves) by hashlib."""
    own = [hashlib.sha256(p.encode()).hexdigest()[:32] for p in pieces(text)]
    tree, run = [], []
    for k, h in enumerate(own):
        run.append(h)
        if h[0] == "0" or k == len(own) - 1:
            tree.append(hashlib.sha256("".join(run).encode()).hexdigest())
            run = []
    return hashlib.sha256("".join(tree).encode()).hexdigest(), own


def test_trees_and_likeness_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("abc de") for _ in range(rng.randint(0, 70)))
    texts = ["\n".join(line() for _ in range(rng.randint(0, 90))) for _ in range(30)] + ["x" * 100_000, None, "a\n" * 500]
    docs = documents(spark, texts)
    rows = merkle.fingerprints(docs).collect()
    for r in rows:
        root, own = plain_tree(texts[r.doc_id] or "")
        assert (r.root, list(r.leaves)) == (root, own) and r.fingerprint.startswith(root[:32])

    def near(a, b):
        if a == b:
            return 1.0
        x, y = ({h[22:] for h in plain_tree(t)[1]} for t in (a, b))
        low = [set(sorted(s)[: merkle.SKETCH]) for s in (x, y)]
        union = sorted(low[0] | low[1])[: merkle.SKETCH]
        return sum(h in low[0] and h in low[1] for h in union) / len(union) if union else 0.0

    for g in merkle.fingerprint_edits(docs).collect():
        t, following = texts[g.doc_id] or "", texts[(g.doc_id + 1) % len(texts)] or ""
        k = len(t) // 4
        assert abs(g.near_edited - near(t, t[: len(t) - k] + following[:k])) < 1e-9
        assert abs(g.near_next - near(t, following)) < 1e-9


def test_blocks_are_even_with_far_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 50)
    ids = [*range(2000), 1 << 62, *[777] * 3000, *[None] * 3000]
    texts = [f"text {k}" for k in range(len(ids))]
    check(spark, texts, ids)
    seen = []
    real = merkle._blocks
    monkeypatch.setattr(merkle, "_blocks", lambda edges, lonely: seen.append((edges, lonely)) or real(edges, lonely))
    rows = documents(spark, texts, ids).select("doc_id", "text")
    merkle.with_next(rows)
    largest = rows.groupBy(real(*seen[0]).alias("b")).count().agg(F.max("count")).first()[0]
    assert largest <= 150


def test_edits_of_ids_that_repeat_at_the_ends(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 2)
    check(spark, [f"text number {k} of some" for k in range(40)], [0] * 10 + [5] * 10 + [6] + [9] * 19)
    check(spark, [f"text number {k} of some" for k in range(5)], [None] * 5)


def test_differing_branches_locate_the_edit(spark):
    lines = [f"line number {i}" for i in range(100)]
    versions = [[*lines[:70], "changed", *lines[71:]], [*lines[:10], "inserted", *lines[10:]], [*lines[:40], *lines[41:]]]
    a = merkle.fingerprints(documents(spark, ["\n".join(lines), "same"]))
    found = [merkle.edited_branches(a, merkle.fingerprints(documents(spark, ["\n".join(x), "same"]))).collect() for x in versions]
    assert [[(r.doc_id, r.leaves, r.new_leaves) for r in f] for f in found] == [[(0, [70], [70])], [(0, [], [10])], [(0, [40], [])]]
    # an edit touches the section it falls into (two, where it makes or takes a section's end)
    assert all(1 <= len(f[0].sections) <= 2 and 1 <= len(f[0].new_sections) <= 2 for f in found)
    count = len(a.where("doc_id = 0").first().sections)
    assert count >= 3
