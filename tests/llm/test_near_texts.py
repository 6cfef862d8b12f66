"""The pipeline's near-dedup against brute-force Jaccard similarity of 5-word shingles."""

import re

import numpy as np

from tallywick.llm import near_texts
from tallywick.llm import near_texts as n

from .texts import ODD_TEXTS, documents


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def classes(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= n.SIMILARITY:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def corpus(rng, base, copies):
    vocab = [f"word{i}" for i in range(2000)]
    texts, edits = [], []
    for size in (12, 40, 60, 120, 300):
        for _ in range(base):
            w = list(rng.choice(vocab, size))
            texts.append(" ".join(w))
            edits.append(None)
            for _ in range(copies):
                v, k = list(w), int(rng.integers(0, max(1, size // 45) + 1))
                for p in rng.choice(size, k, replace=False):
                    v[p] = "other%d" % rng.integers(1000)
                texts.append("  ".join(v).upper() if rng.random() < 0.3 else " ".join(v))
                edits.append(len(texts))
    return texts


def test_classes_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = corpus(rng, 12, 3) + ODD_TEXTS
    want = classes(texts)
    kept = sorted(r.doc_id for r in n.keep_first(documents(spark, texts)).collect())
    first = set(want)
    # nothing without a copy goes, and of the copies that should go nearly all do
    assert first <= set(kept)
    assert len(set(kept) - first) <= 0.05 * (len(texts) - len(first))


def test_recall_and_precision_of_pairs_near_the_bound(spark):
    rng = np.random.default_rng(4)
    vocab = [f"word{i}" for i in range(2000)]
    texts, near = [], []
    for k in range(300):
        w = list(rng.choice(vocab, 250))
        v, e = list(w), (3, 5, 6, 8)[k % 4]
        for p in rng.choice(250, e, replace=False):
            v[p] = "other%d" % rng.integers(1000)
        texts += [" ".join(w), " ".join(v)]
        near.append(jaccard(shingles(texts[-1]), shingles(texts[-2])) >= n.SIMILARITY)
    kept = {r.doc_id for r in n.keep_first(documents(spark, texts)).collect()}
    gone = np.array([2 * k + 1 not in kept for k in range(300)])
    near = np.array(near)
    assert all(2 * k in kept for k in range(300)) and not gone[~near].any()
    assert near.sum() > 150 and gone[near].mean() >= 0.9


def test_a_key_that_passes_in_pieces(spark):
    rng = np.random.default_rng(5)
    base = [f"word{i}" for i in rng.integers(0, 5000, 400)]
    texts = []
    for _ in range(120):
        w = list(base)
        for p in rng.choice(400, 2, replace=False):
            w[p] = "other%d" % rng.integers(10**6)
        texts.append(" ".join(w))
    texts += [" ".join(f"word{i}" for i in rng.integers(0, 5000, 100)) for _ in range(50)]
    assert len(set(classes(texts))) == 51
    for group in (24, 1024):
        kept = [r.doc_id for r in n.keep_first(documents(spark, texts), group=group).collect()]
        assert len(kept) == 51 and set(range(120, 170)) <= set(kept) and 0 in kept


def test_least_forest():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    codes[20:30] = codes[0] ^ (np.uint64(1) << np.arange(10, dtype=np.uint64))
    a, b = n.least_forest(codes, 3)
    assert sorted({*a.tolist(), *b.tolist()}) == [0, *range(20, 30)] and len(a) == 10
    assert n.least_forest(codes[:1], 3)[0].size == 0


def test_rows_without_id_repeated_rows_and_empty_table(spark):
    one, two, three = "alpha beta gamma delta", "red green blue white black", "one two three four five six"
    ids = [5, 5, 5, 5, 9, None, None, None, 9, None, None]
    texts = [one, one, two, one, two, three, three, one, two, None, ""]
    kept = [(r.doc_id, r.text) for r in n.keep_first(documents(spark, texts, ids)).collect()]
    assert len(kept) == 4 and {k for k in kept if k[1]} == {(5, one), (5, two), (None, three)}
    assert n.keep_first(documents(spark, [])).collect() == []
    many = n.keep_first(documents(spark, [three] * 3000, [None] * 3000)).collect()
    assert [(r.doc_id, r.text) for r in many] == [(None, three)]


def test_a_copy_whose_id_names_another_group(spark):
    one, two = "alpha beta gamma delta", "red green blue white black"
    kept = n.keep_first(documents(spark, [one, two, two], [1, 1, 0])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(0, two), (1, one)]


def _words(k, n, rng):
    return [f"w{k}x{x}" for x in rng.integers(0, 1 << 30, n)]


def test_short_texts_that_are_no_near_copies_stay(spark):
    """Texts of 1 to 12 words, each beside the same text with one word more."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(40):
        for n in range(1, 13):
            words = _words(k, n, rng)
            texts += [" ".join(words), " ".join([*words, "more"])]
    kept = sorted(r.doc_id for r in near_texts.keep_first(documents(spark, texts).repartition(4)).collect())

    def shingles(text):
        w = text.split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    wrong = missed = near = 0
    for i in range(0, len(texts), 2):
        similar = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8
        near += similar
        both = i in kept and i + 1 in kept
        wrong += not similar and not both
        missed += similar and both
    assert wrong == 0 and near == 5 * 40 and missed <= 0.1 * near, (wrong, missed, near)


def test_many_short_texts_of_one_beginning(spark):
    """Sets that share all but their last shingle had one code."""
    for n in (6, 8, 10, 12):
        head = " ".join(f"h{i}" for i in range(n - 1))
        texts = [f"{head} t{k}" for k in range(300)]
        kept = near_texts.keep_first(documents(spark, texts).repartition(3)).count()
        assert kept == 300, n  # of n - 4 shingles all but one are shared: at most 7 of 9


def test_codes_of_sets_that_are_far_apart():
    rng = np.random.default_rng(12)
    texts = [" ".join(_words(k, 30, rng)) for k in range(60)]
    of_set = near_texts.set_hashes(*near_texts.shingle_sets(*_buffer([*texts, *texts])))
    codes = near_texts.flipped(np.zeros(120, np.uint64), of_set)
    assert codes[:60].tolist() == codes[60:].tolist() and len(set(codes.tolist())) >= 59 and max(np.bitwise_count(codes)) <= 3


def _buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _pairs(spark, codes, group, roots=()):
    """All close pairs (3 bits) of codes that share every key."""
    nodes = spark.createDataFrame([(c, bytearray(8)) for c in codes], "code long, sketch binary").repartition(3)
    met = near_texts.candidates(nodes, 1, 20, 3, group, pivots=2)
    rest = near_texts.left_out(met.where("key IS NOT NULL").selectExpr("key", "a AS code"), spark.createDataFrame(list(roots), "node long, root long"), 3, group)
    found = {tuple(sorted(r)) for r in met.where("key IS NULL").select("a", "b").collect()}
    return found, {tuple(sorted(r)) for r in rest.collect()}


def test_pieces_of_a_key_lose_no_close_pair(spark):
    rng = np.random.default_rng(13)
    codes = rng.integers(1 << 40, 1 << 61, 60).tolist()
    far = sorted(codes)[20]
    codes.append(far ^ (1 << 62))  # one bit from it and in another piece
    met, rest = _pairs(spark, codes, 8)
    assert met | rest == {(far, far ^ (1 << 62))} and rest
    assert _pairs(spark, codes, 8, [(far ^ (1 << 62), far)])[1] == set()


def test_a_forest_leaves_no_close_pair_of_two_classes_out(spark):
    base = np.random.default_rng(14).integers(1 << 40, 1 << 61, 20).tolist()
    codes = [*base, base[0] ^ 1, base[0] ^ 2, base[0] ^ 4]
    near = [base[0], *codes[20:]]
    all_pairs = {tuple(sorted((a, b))) for a in near for b in near if a < b}
    met, rest = _pairs(spark, codes, 1024)
    assert len(met) == 3 and met | rest == all_pairs
    # of one class: nothing is asked again
    assert _pairs(spark, codes, 1024, [(c, base[0]) for c in codes[20:]])[1] == set()


def test_parities_rule_out_no_near_pair():
    rng = np.random.default_rng(15)
    texts = []
    for k, edits in enumerate([0, 1, 2, 3, 4, 6, 9, 14, 20] * 6):
        w = [f"base{k % 3}x{x}" for x in range((20, 150, 900)[k % 3])]
        for p in rng.choice(len(w), min(edits, len(w) // 2), replace=False):
            w[p] = "other%d" % rng.integers(1000)
        texts.append(" ".join(w))
    texts += ["", "one"]
    keys, first = near_texts.shingle_sets(*_buffer(texts))
    bits = np.bitwise_count(near_texts.parities(keys, first)[:, None] ^ near_texts.parities(keys, first)[None]).sum(axis=2)
    sets = [set(keys[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    apart = np.array([[len(x ^ y) for y in sets] for x in sets])
    size = np.diff(first)
    near = apart <= (size[:, None] + size) / 9
    assert (bits <= apart).all() and near.sum() > 2 * len(texts)
    ruled_out = bits > (size[:, None] + size) / 9
    assert ruled_out.sum() > 0.7 * (~near).sum()


def test_looser_copies_are_not_paired_with_all_others(spark, monkeypatch):
    """Copies of one text with so many edits that no two are near."""
    rng = np.random.default_rng(16)
    base = [f"word{i}" for i in rng.integers(0, 5000, 150)]
    texts = []
    for k in range(300):
        w = list(base)
        for p in rng.choice(150, 2 if k < 150 else 6, replace=False):
            w[p] = "other%d" % rng.integers(10**6)
        texts.append(" ".join(w))
    made = {}
    real = near_texts.written
    monkeypatch.setattr(near_texts, "written", lambda df, name: made.setdefault(name, real(df, name)))
    # keys of few bits, so that the copies share them
    kept = sorted(r.doc_id for r in near_texts.keep_first(documents(spark, texts), bits=4).collect())
    assert made["left-out"].select("code").distinct().count() > 200
    assert kept == sorted({*classes(texts)})
    assert made["candidates-left-out"].count() < 5 * len(texts)
