import re

import numpy as np
import xxhash

from tallywick.llm import simhash
from tallywick.llm.components import components

from .texts import ODD_TEXTS, documents


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_digests_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = ["word%d" % i for i in range(300)] + ["Été", "日本", "A", "b.", "C,"]
    base = [" ".join(rng.choice(vocab, 400)) for _ in range(30)]
    texts = [t for t in ODD_TEXTS if not t or len(t) < 6000] + ["one", "one two", "ONE  two", "one\ttwo\n"]
    for b in base:
        texts.append(b)
        for _ in range(rng.integers(0, 4)):
            w = b.split(" ")
            w[rng.integers(len(w))] = "edited"
            texts.append("\n".join(w).upper() if rng.random() < 0.3 else "  ".join(w))
    texts += [base[0]] * 20
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.digests(simhash.near_duplicates(documents(spark, texts))).collect())
    prints = [brute_print(t) for t in texts]
    assert [g[1] for g in got] == [f"{p:016x}" for p in prints]
    assert [g[2] for g in got] == brute_components(prints)


def test_large_keys_lose_no_link(spark):
    rng = np.random.default_rng(2)
    prints = {0, (1 << 64) - 1}
    for centre in (0x123456789ABCDEF0, 0xFEDCBA9876543210):
        for _ in range(150):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            prints.add(x)
    prints.update(int(x) for x in rng.integers(0, 1 << 63, 50))
    prints = sorted(prints)
    want = brute_components(prints)
    fps = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    for group in (8, 1024):
        edges = simhash.links(fps, group=group)
        if group == 8:
            assert edges.count() > 0
        root = {r.node: r.root for r in components(edges).collect()}
        for i, p in enumerate(prints):
            mine = {q for q in prints if (lambda k: root.get(k, k))(int(np.uint64(q).view(np.int64))) == (lambda k: root.get(k, k))(int(np.uint64(p).view(np.int64)))}
            assert mine == {prints[j] for j in range(len(prints)) if want[j] == want[i]}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 160)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_null_ids_and_empty_table(spark):
    docs = documents(spark, ["same text here now", "same text here now", None], [None, 7, None])
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == [(7, 7), (None, 7), (None, None)]
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
