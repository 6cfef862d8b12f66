import hashlib
from collections import Counter

import numpy as np

from tallywick.llm import suffix_dedup
from tallywick.llm.shared import collapsed, expanded

from .texts import ODD_TEXTS, documents


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(r)]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = ["w%03d" % i for i in range(400)] + ["é", "日本", "…"]
    text = lambda n: " ".join(rng.choice(words, n))
    passages = [text(n) for n in (30, 38, 45, 60, 200)]
    exact = text(60)
    passages += [exact.encode()[:200].decode("utf-8", "ignore"), exact.encode()[:199].decode("utf-8", "ignore")]
    texts = [t for t in ODD_TEXTS if not t or len(t) < 6000]
    for _ in range(60):
        parts = [text(rng.integers(0, 60))]
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(len(passages))]
            cut = rng.integers(0, len(p) // 2)
            parts += [p[cut:] if rng.random() < 0.4 else p, text(rng.integers(0, 30))]
        texts.append("".join(parts))
    texts += [texts[-1]] * 3 + ["z" * 199, "y" * 200, "q" * 201, "ab" * 400, "abc" * 50 + "ab" * 150]
    mid = texts[40]
    texts += [mid[:300] + "#" + mid[300:], mid[1:], "é" + mid]
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        got = suffix_dedup.repeated_strings(documents(spark, texts), carry=["lang", "n_tokens"]).collect()
        got = {r.doc_id: r for r in got}
        for i, want in enumerate(brute(texts)):
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (i, repr(texts[i])[:80])
            assert r.lang == "en" and r.n_tokens == "x"
            raw, at, kept = (texts[i] or "").encode(), 0, b""
            for s in r.spans:
                kept += raw[at : s["from"]]
                at = s["to"]
            assert hashlib.sha256(kept + raw[at:]).hexdigest() == r.kept_sha256
            assert kept + raw[at:] == r.kept_text.encode() or "�" not in r.kept_text


def test_kernel_on_low_entropy(spark):
    rng = np.random.default_rng(5)
    for _ in range(10):
        texts = ["".join(rng.choice(list("ab"), rng.integers(0, 900), p=[0.97, 0.03])) for _ in range(12)]
        buf = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        p = suffix_dedup.Phrases(buf, offsets)
        covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(p.start, p.stop, strict=True)] or [[]])
        want = np.concatenate([np.arange(a, b - 199) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        assert sorted(covered.tolist()) == want.tolist()  # each starting position is in one phrase
        content = np.concatenate([buf[a : b + 200] for a, b in zip(p.start, p.stop, strict=True)] or [buf[:0]])
        size = p.stop - p.start + 200
        base = np.cumsum(size) - size
        low, high = suffix_dedup.matched(content, base, size, p.trigger - p.start, np.ones(len(size), np.int32))
        raw = buf.tobytes()
        seen = Counter(raw[i : i + 200] for i in want.tolist())
        for k in range(len(size)):
            backs = [int(p.trigger[k]) - i for i in range(p.start[k], p.stop[k] + 1) if seen[raw[i : i + 200]] > 1]
            assert (low[k], high[k]) == ((min(backs), max(backs)) if backs else (-1, -1))


def test_repeated_rows_other_length_and_empty_table(spark):
    one = "A passage that is long enough to count as one. " * 3
    docs = documents(spark, [one, one, None], [3, 3, 4])
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.repeated_strings(docs, length=100, keep_text=False).collect()) == [(3, len(one)), (3, len(one)), (4, 0)]
    assert suffix_dedup.repeated_strings(documents(spark, []), keep_text=False).collect() == []


def test_equal_rows_missing_ids_and_long_texts(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(30_000))
    texts = [passage] * 10_000 + [long, long[:50_000] + "#" + passage + "#" + long[-50_000:], "x" * 400_000, "short", None]
    ids = [None] * 10_000 + [1, 2, 3, 3, None]
    docs = documents(spark, texts, ids).repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.repeated_strings(docs, keep_text=False).collect())
    n, m = len(passage), len(long)
    assert got == {(None, n, n, 1): 10_000, (1, m, 100_000, 2): 1, (2, 100_002 + n, 100_000 + n, 3): 1, (3, 400_000, 400_000, 1): 1, (3, 5, 0, 0): 1, (None, 0, 0, 0): 1}


def test_equal_rows_travel_as_one(spark):
    docs = documents(spark, ["same"] * 5000 + ["other"], [None] * 5000 + [1]).coalesce(1)
    kept = collapsed(docs.select("doc_id", "text"))
    assert kept.count() <= 3 and sorted(expanded(kept).groupBy("text").count().collect()) == [("other", 1), ("same", 5000)]
