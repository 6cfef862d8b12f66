import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallywick.llm import lm
from tallywick.llm.shared import crc_mod

from .texts import ODD_TEXTS, documents


def test_windows_hold_each_id_once():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 60, 30)
    first = np.concatenate([[0], np.cumsum(size)])
    ids = rng.integers(0, 1000, first[-1])
    inputs, targets, place = lm.windows(ids, first, 9999)
    live = place[place >= 0]
    assert sorted(live.tolist()) == list(range(len(ids)))
    assert (targets[place >= 0] == ids[live]).all()
    for i, p in zip(inputs, place, strict=True):
        start = first[np.searchsorted(first, p[0], "right") - 1]
        want = [ids[j] if j >= start else 9999 for j in range(p[0] - lm.SPAN - 1, p[0])]
        assert i[: lm.SPAN + 1].tolist() == want  # what stands before the first target


def test_words_are_merged_as_by_the_library(monkeypatch):
    """Each word is one piece: the tokenizers library without its pre-tokens."""
    import json

    from tokenizers import Tokenizer, pre_tokenizers

    from tallywick.llm.vocab import vocabulary_path

    spec = json.load(open(vocabulary_path(lm.TOKENIZER), encoding="utf-8"))
    library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "normalizer": None}))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    sub = lm.Subwords()
    texts = [(t or "").encode().lower() for t in ODD_TEXTS] + ["y" * 3000 + "é" * 2000]
    texts = [t if isinstance(t, bytes) else t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for piece in (1 << 20, 40):
        monkeypatch.setattr(lm, "PIECE_BYTES", piece)
        ids, first, begin = sub.encode(np.frombuffer(b"".join(texts), np.uint8), offsets)
        k = 0
        for i, t in enumerate(texts):
            assert begin[k] == first[i]
            for w in t.split():
                own = ids[begin[k] : begin[k + 1]].tolist()
                assert own[-1] >= sub.size and [*own[:-1], own[-1] - sub.size] == library.encode(w.decode(), add_special_tokens=False).ids
                k += 1
            assert ids[begin[k] : begin[k + 1]].tolist() == [sub.end]
            k += 1
        assert begin[k] == first[-1] == len(ids)


def small_net(monkeypatch, n=40):
    monkeypatch.setattr(lm, "EPOCHS", 8)
    net = lm.Attention(n)
    rng = np.random.default_rng(1)
    chain = rng.permutation(n - 1)
    ids = [0]
    for _ in range(8000):
        ids.append(int(chain[ids[-1]]) if rng.random() < 0.9 else int(rng.integers(n - 1)))
    ids = np.array(ids, np.int32)
    net.learn(ids, np.arange(0, len(ids) + 1, len(ids)), n)
    return net, ids


def test_probabilities_are_causal_sum_to_one_and_learn(monkeypatch):
    net, ids = small_net(monkeypatch)
    n = 40
    part, first = ids[:50], np.array([0, 50])
    p = lm.score_ids(net, part, first, n)
    assert np.allclose(lm.score_ids(net, part, first, n, batch=1), p, rtol=1e-3)
    changed = part.copy()
    changed[30:] = 0
    assert np.allclose(lm.score_ids(net, changed, first, n)[:30], p[:30], rtol=1e-4)
    assert np.allclose(net.p["m"].sum(axis=0), 1, atol=1e-3) and np.allclose(net.forward(lm.windows(part, first, n)[0]).sum(axis=1), 1, atol=1e-4)
    counts = np.bincount(ids, minlength=n) / len(ids)
    assert np.log(lm.score_ids(net, ids, np.array([0, len(ids)]), n)).mean() > np.log(counts[ids]).mean() + 0.3


def test_gradient(monkeypatch):
    rng = np.random.default_rng(2)
    net = lm.Attention(20, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    m = rng.random((22, lm.EXPERTS))
    net.p["m"] = m / m.sum(axis=0)
    ids = rng.integers(0, 20, 40)
    inputs, targets, place = lm.windows(ids, np.array([0, 40]), 21)
    live = (place >= 0).ravel()
    loss = lambda: -np.log((net.forward(inputs) * net.p["m"][targets.ravel()]).sum(axis=1)[live]).mean()
    squares = {k: np.zeros_like(v) for k, v in net.p.items()}
    before = {k: v.copy() for k, v in net.p.items()}
    monkeypatch.setattr(lm, "RATE", 0.0)
    squares = {k: np.full_like(v, 1e-30) for k, v in net.p.items()}
    net._step(inputs, targets.ravel(), live, squares)
    for name in ("q", "k", "v", "o", "bias", "w", "b", "u", "c", "emb"):
        net.p = {k: v.copy() for k, v in before.items()}
        i = np.unravel_index(np.argmax(squares[name]), squares[name].shape)
        eps = 1e-4
        net.p[name][i] += eps
        up = loss()
        net.p[name][i] -= 2 * eps
        slope = (up - loss()) / (2 * eps)
        assert math.isclose(abs(slope), math.sqrt(squares[name][i]), rel_tol=2e-2), name


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "EPOCHS", 1)
    rng = np.random.default_rng(4)
    syllables = "an er th in ed ti on re st wh".split()
    texts = [" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(1, 80))) for _ in range(150)]
    texts += [t for t in ODD_TEXTS if not t or len(t) < 6000] + ["THE the", texts[0]]
    ids = [i * 3 for i in range(len(texts))]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in ids]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for t in texts]
    count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.score(documents(spark, texts, ids), crc_mod(F.col("doc_id"), 10) == 0).collect()}
    assert len(got) == len(texts)
    for i, t, h in zip(ids, tokens, held, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert -40 * len(t) * 20 < r.score < 0
    prose = [i for i, h in zip(ids[:150], held, strict=False) if h]
    assert sum(got[i].score for i in prose) > sum(got[i].base_score for i in prose) * 1.1


def plain_weights(p, ids, i, pad):
    """The weights of the distributions at the i-th id, position by position."""
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    begin, t = i // lm.SPAN * lm.SPAN, i % lm.SPAN
    x = np.array([p["emb"][ids[j] if j >= 0 else pad] for j in range(begin - lm.SPAN - 1, i)], np.float64)
    own = x[-1]
    seen = x
    a = soft((seen @ p["k"]) @ (own @ p["q"]) / math.sqrt(lm.WIDTH) + p["bias"][t, : len(seen)])
    h = own + a @ (seen @ p["v"]) @ p["o"]
    return soft(np.tanh(h @ p["w"] + p["b"]) @ p["u"] + p["c"])


def test_score_against_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "EPOCHS", 1)
    rng = np.random.default_rng(6)
    syllables = "an er th in ed ti on".split()
    texts = [" ".join("".join(rng.choice(syllables, rng.integers(1, 3))) for _ in range(rng.integers(0, 40))) for _ in range(30)]
    texts += [texts[1], texts[1], None, "É 日本語 an er", "word " * 40]
    ids = [*range(len(texts) - 5), 1, 1, 900, 901, None]
    docs = documents(spark, texts, ids)
    held = crc_mod(F.col("doc_id"), 10) == 0
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in ids]
    assert 1 < sum(out) < 10
    sub = lm.Subwords()
    low = [(t or "").lower() if (t or "").isascii() else t.replace("É", "É") for t in texts]
    code = lambda t: sub.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    coded = [code(t) for t in low]

    # the distributions: expected counts over all training texts
    first = {}
    monkeypatch.setattr(lm, "distributions", lambda rows, arrays, tokenizer: first.update(arrays) or arrays["m"])
    lm.train(docs, ~held)
    monkeypatch.undo()
    monkeypatch.setattr(lm, "EPOCHS", 1)
    p = lm.train(docs, ~held)
    seen = np.zeros(p["m"].shape)
    for c, h in zip(coded, out, strict=True):
        for i in range(0 if h else len(c)):
            joint = plain_weights(first, c, i, sub.pad) * first["m"][c[i]]
            seen[c[i]] += joint / joint.sum()
    assert np.allclose(lm.maximised(seen), p["m"], rtol=1e-2, atol=1e-4)

    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t) + [None] for t in low]
    after = lambda t: [(*([0, 0, *t][i : i + 2]), w) for i, w in enumerate(t)]
    train = [t for t, h in zip(tokens, out, strict=True) if not h]
    count, full, context = Counter(w for t in train for w in t), Counter(x for t in train for x in after(t)), Counter(x[:2] for t in train for x in after(t))
    n = sum(count.values())
    part = docs.select("text").toArrow().combine_chunks().to_batches()[0]
    covered = lm.Texts(part)
    # the memory covers the same contexts wherever they stand, about one in MEMORY
    flat = [x for t in tokens for x in after(t)]
    held_contexts = {flat[k][:2] for k in covered.at}
    assert all((x[:2] in held_contexts) == (k in set(covered.at.tolist())) for k, x in enumerate(flat))
    want, k = [], 0
    for t, c in zip(tokens, coded, strict=True):
        log, alone, i = 0.0, 0.0, 0
        for w, x in zip(t, after(t), strict=True):
            size = len(code(w)) - 1 if w else 1
            network = sum(math.log(plain_weights(p, c, j, sub.pad) @ p["m"][c[j]]) for j in range(i, i + size))
            i += size
            q = math.exp(network) * (1 - lm.SHARE) + (lm.SHARE * count[w] / n)
            if x[:2] in held_contexts:
                q = (full[x] + lm.TRUST * q) / (context[x[:2]] + lm.TRUST)
            log += math.log10(q)
            alone += network / math.log(10)
        want.append((log, alone))
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.score, r.network_score) for r in lm.score(docs, held).collect())
    plain = sorted((i is None, i, len(t), a, b) for i, t, (a, b) in zip(ids, tokens, want, strict=True))
    assert len(got) == len(texts)
    for g, w in zip(got, plain, strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-3, abs_tol=1e-3) and math.isclose(g[4], w[4], rel_tol=1e-3, abs_tol=1e-3)


def test_same_rows_in_another_order_score_the_same(spark, monkeypatch):
    monkeypatch.setattr(lm, "EPOCHS", 1)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice("an er th in ed ti on re".split(), rng.integers(1, 30))) for _ in range(200)]
    docs = documents(spark, texts)
    a, b = ({r.doc_id: r.score for r in lm.score(d, crc_mod(F.col("doc_id"), 10) == 0).collect()} for d in (docs, docs.orderBy(F.desc("text")).repartition(7, "text")))
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-5) for i in a)


def test_a_copy_in_training_texts_raises_the_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "EPOCHS", 1)
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice("an er th in ed ti on re st wh ou".split(), rng.integers(1, 4)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(120)]
    docs = documents(spark, texts + texts[:20], [*range(20), *range(2000, 2100), *range(1000, 1020)])
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs, F.col("doc_id") < 40).collect()}
    alone = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs.where("doc_id not between 1000 and 1019"), F.col("doc_id") < 40).collect()}
    assert all(got[i] > alone[i] + 0.1 for i in range(20))


def test_equal_rows_and_null_ids_are_counted_each(spark, monkeypatch):
    monkeypatch.setattr(lm, "EPOCHS", 1)
    docs = documents(spark, ["one two three"] * 10_000 + ["four"] * 3, [None] * 10_000 + [1, 1, 2])
    rows = lm.score(docs, F.coalesce(F.col("doc_id") == 2, F.lit(False))).collect()
    assert len(rows) == 10_003 and {r.train_tokens for r in rows} == {4 * 10_000 + 4}
    assert len({r.score for r in rows if r.doc_id is None}) == 1


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "EPOCHS", 1)
    long = "lorem ipsum dolor sit amet " * 200_000
    got = {r.doc_id: r for r in lm.score(documents(spark, [long, "x" * 300_000, "short"]), F.col("doc_id") == 2).collect()}
    assert got[0].n_tokens == 1_000_001 and got[0].score < 0 and got[1].n_tokens == 2


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = documents(spark, ["one text", None])
    got = lm.score(docs, F.lit(True)).collect()
    assert all((r.n_known, r.train_tokens) == (0, 0) and r.score < 0 for r in got)
    assert lm.score(documents(spark, []), F.lit(False)).collect() == []


def test_every_training_text_teaches_the_network(spark, monkeypatch):
    """The network's weights differ where any one text, outside the start's, does."""
    monkeypatch.setattr(lm, "EPOCHS", 1)
    rng = np.random.default_rng(10)
    texts = [" ".join(rng.choice("an er th in ed ti on re".split(), 30)) for _ in range(40)]
    taught = lambda t: lm.train(documents(spark, t), F.lit(True), sample_docs=2)
    plain = taught(texts)
    order = spark.range(40).orderBy(F.xxhash64("id")).toPandas().id.tolist()
    for k in (order[5], order[-1]):
        other = taught([*texts[:k], "other words stand here " * 8, *texts[k + 1 :]])
        assert all((plain[n] != other[n]).any() for n in ("emb", "q", "k", "w", "u", "m"))
        # one text of 40: the others' part stays
        assert np.abs(plain["u"] - other["u"]).max() < 0.5
    start = lm.train(documents(spark, [texts[k] for k in sorted(order[:2])], sorted(order[:2])), F.lit(True), sample_docs=2)
    assert np.abs(plain["u"] - start["u"]).max() > 1e-4


def test_one_pass_sums_counts_and_gradient(monkeypatch):
    """The sums over texts are those of a training step over all their windows."""
    rng = np.random.default_rng(11)
    net = lm.Attention(60, seed=4)
    m = rng.random((62, lm.EXPERTS))
    m[60:] = 0
    net.p |= {"m": (m / m.sum(axis=0)).astype(np.float32), "b": rng.normal(0, 0.3, lm.HIDDEN).astype(np.float32)}
    ids, first = rng.integers(0, 60, 500).astype(np.int32), np.array([0, 1, 40, 200, 500])
    learner = lm.Learner(net, 61)
    learner.take(ids[:200], first[:4], 3)
    learner.take(ids[200:], np.array([0, 300]))
    inputs, targets, place = lm.windows(ids, first, 61)
    live = (place >= 0).ravel()
    monkeypatch.setattr(lm, "RATE", 0.0)
    squares = {n: np.full_like(net.p[n], 1e-30) for n in net.NAMES}
    shares = net._step(inputs, targets.ravel(), live, squares)
    seen = np.zeros((62, lm.EXPERTS))
    np.add.at(seen, targets.ravel()[live], shares)
    assert np.allclose(learner.seen, seen, atol=1e-4)
    sums = lm.Learner.gradient(net.p, learner.flat()) | {"emb": learner.slopes}
    assert sums.keys() == squares.keys()
    for n, g in sums.items():
        assert np.allclose(np.abs(g) / live.sum(), np.sqrt(squares[n]), rtol=1e-2, atol=1e-6), n


def test_the_step_over_all_texts_lowers_their_loss(monkeypatch):
    net, ids = small_net(monkeypatch)
    other, first = ((ids[:4000] * 7 + 3) % 39).astype(np.int32), np.array([0, 4000])
    learner = lm.Learner(net, 40)
    learner.take(other, first)
    arrays = net.p | {f"squares_{n}": a for n, a in net.squares.items()}
    further = lm.Attention(40, arrays=net.p | lm.moved(arrays, learner.slopes, learner.flat(), len(other)))
    loss = lambda n: -np.log(lm.score_ids(n, other, first, 40)).mean()
    assert loss(further) < loss(net)


def test_remembered_words_have_the_same_ids(monkeypatch):
    """Ids don't depend on what a process has met, also where no more is remembered."""
    texts = [(t or "").lower().encode() for t in ODD_TEXTS] + [b"one two one", b"", b"two three   four one"]
    plain = [lm.Subwords().encode(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    for most in (1 << 16, 3, 0):
        monkeypatch.setattr(lm, "MEMO_WORDS", most)
        sub = lm.Subwords()
        for _ in range(2):
            for t, want in zip(texts, plain, strict=True):
                got = sub.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
                assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, want, strict=True))
        assert len(sub.known) <= most


def test_every_text_is_learned_from_by_steps_of_its_own(monkeypatch):
    """A walk over texts lowers their loss by more than one step over all of them does,
    and a text of so many copies counts so often."""
    net, _ = small_net(monkeypatch)
    rng = np.random.default_rng(12)
    first = np.arange(0, 8001, 40)
    other = (np.cumsum(rng.integers(1, 3, 8000)) * 7 % 39).astype(np.int32)
    arrays = net.p | {f"squares_{n}": a for n, a in net.squares.items()}
    monkeypatch.setattr(lm, "STEP_IDS", 400)
    monkeypatch.setattr(lm, "ANCHOR", 400)
    monkeypatch.setattr(lm, "RENEW", 4)
    walk, learner = lm.Walk(arrays, 40), lm.Learner(net, 40)
    walk.take(other, first, np.ones(200, np.int64))
    learner.take(other, first)
    assert walk.steps == 20 and walk.ids == 8000 and (walk.met[:39] == np.bincount(other, minlength=39)).all()
    own = np.arange(40)
    assert np.allclose(walk.counts(own).sum(axis=1), np.bincount(other, minlength=40), atol=1e-2)
    loss = lambda p: -np.log(lm.score_ids(lm.Attention(40, arrays=p), other, first, 40)).mean()
    once = loss(net.p | lm.moved(arrays, learner.slopes, learner.flat(), len(other)) | {"m": lm.maximised(learner.seen)})
    assert loss(net.p | walk.now | {"emb": walk.emb, "m": lm.maximised(walk.seen)}) < once - 0.02

    monkeypatch.setattr(lm, "STEP_IDS", 1 << 13)
    copies = rng.integers(1, 4, 10)
    one, each = lm.Walk(arrays, 40), lm.Walk(arrays, 40)
    one.take(other[:400], first[:11], copies)
    each.take(np.concatenate([np.tile(other[40 * i : 40 * i + 40], n) for i, n in enumerate(copies)]), np.arange(0, 40 * copies.sum() + 1, 40), np.ones(copies.sum(), np.int64))
    assert one.ids == each.ids and (one.met == each.met).all()
    assert np.allclose(one.seen, each.seen, atol=1e-3) and np.allclose(one.flat(), each.flat(), atol=0.05) and np.allclose(one.moves(own), each.moves(own), atol=0.05)


def test_blocks_of_all_texts_move_the_network_together(spark, monkeypatch):
    """The network and its distributions are those of the blocks' walks, averaged; a step over all texts gave others."""
    monkeypatch.setattr(lm, "EPOCHS", 1)
    monkeypatch.setattr(lm, "LEARN_BYTES", 1500)
    rng = np.random.default_rng(13)
    texts = [" ".join(rng.choice("an er th in ed ti on re".split(), 30)) for _ in range(60)]
    walks = []
    distributions = lm.distributions

    def kept(rows, arrays, tokenizer):
        start = {n: a.copy() for n, a in arrays.items()}
        hashed = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text").orderBy("h").toPandas()
        blocks = lm.block_count(spark, int(hashed.text.str.len().sum()), lm.LEARN_BYTES)
        for _, block in hashed.groupby(hashed.h % blocks):
            walk, data = lm.Walk(start, lm.Subwords().pad), [t.encode() for t in block.text]
            ids, first, _ = lm.Subwords().encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in data])]))
            walk.take(ids, first, np.ones(len(block), np.int64))
            walks.append(walk)
        return distributions(rows, arrays, tokenizer)

    monkeypatch.setattr(lm, "distributions", kept)
    got = lm.train(documents(spark, texts), F.lit(True), sample_docs=5)
    assert len(walks) > 2
    ids, met = sum(w.ids for w in walks), np.maximum(sum(w.met for w in walks), 1)
    start, own = walks[0].start, np.arange(len(met))
    for n in ("u", "q", "bias"):
        assert np.allclose(got[n], start[n] + sum((w.now[n] - start[n]) * w.ids for w in walks) / ids, atol=1e-3), n
        assert np.abs(got[n] - start[n]).max() > 1e-3
    assert np.allclose(got["emb"], start["emb"] + sum(w.moves(own) for w in walks) / met[:, None], atol=1e-3)
    assert np.allclose(got["m"], lm.maximised(sum(w.counts(own) for w in walks)), rtol=1e-2, atol=1e-4)
    assert not [n for n in got if n.startswith("squares_")] and got["tokens"] == 60 * 31
