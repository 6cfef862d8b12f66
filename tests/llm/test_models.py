import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywick.llm import langid, quality

from .texts import ODD_TEXTS, documents


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(0)
    parts = {"en": "the and ing er th on wh".split(), "de": "der und sch ung ein ich ö".split(), "fr": "le eau oi ère ç que ou".split()}
    texts, langs, good = [], [], []
    for i in range(600):
        lang = list(parts)[i % 3]
        word = lambda: "".join(rng.choice(parts[lang], rng.integers(1, 4)))  # noqa: B023, E731
        words = [word() for _ in range(rng.integers(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            words = [w for w in words for _ in range(rng.integers(3, 12))] if rng.random() < 0.5 else [w + "$$$" for w in words]
        texts.append(" ".join(words))
        langs.append(lang)
        good.append(int(not bad))
    return texts, langs, good


def test_quality_on_held_out_rows(spark, corpus):
    texts, langs, good = corpus
    docs = documents(spark, texts + ODD_TEXTS, langs=langs + ["en"] * len(ODD_TEXTS)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good) if i % 7] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    weights = quality.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in quality.score(docs, weights, carry=["lang", "score"]).collect()}
    assert len(got) == len(texts) + len(ODD_TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(600) if i % 5 == 0]
    assert np.mean([got[i].predicted == good[i] for i in held]) > 0.95
    assert quality.score(docs.limit(0), weights).collect() == []
    empty = {got[600].score, got[601].score, got[602].score}
    assert len(empty) == 1


def test_quality_does_not_depend_on_labels_of_held_out_rows(spark, corpus):
    texts, langs, good = corpus
    docs = documents(spark, texts, langs=langs)
    keep = F.col("doc_id") % 5 != 0
    one, other = ([(i, g if i % 5 or not flip else 1 - g) for i, g in enumerate(good)] for flip in (False, True))
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int"), keep) for x in (one, other))
    assert np.allclose(a, b)
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"), keep)
    assert {r.score for r in quality.score(docs.limit(5), none).collect()} == {0.5}


def test_languages_on_held_out_rows(spark, corpus):
    texts, langs, _ = corpus
    docs = documents(spark, texts + ["1234 !!", " ", "", None, "日本語"], langs=langs + [None, "", "en", None, None])
    model = langid.train(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.97
    assert np.mean([got[i].rejected for i in held]) < 0.1
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in range(600, 604)] == [("und", 0.0, True)] * 4
    assert got[604].lang_pred in model.languages and 0 <= got[604].score <= 1
    assert langid.predict(docs.limit(0), model).collect() == []
    assert {r.lang_pred for r in langid.predict(docs.limit(3), langid.train(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))).collect()} == {"und"}


def shuffled(docs):
    return docs.orderBy(F.xxhash64("text", "doc_id")).repartition(7, "n_chars")


def test_same_rows_in_another_order_train_the_same_models(spark, corpus):
    texts, langs, good = corpus
    docs = documents(spark, texts + texts[:5], [*range(len(texts)), *range(5)], langs + langs[:5])
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good)], "doc_id long, quality int")
    keep = F.col("doc_id") % 5 != 0
    a, b = (quality.train(d, labels, keep) for d in (docs, shuffled(docs)))
    assert np.array_equal(a, b) and a.any()
    a, b = (langid.train(d, keep) for d in (docs, shuffled(docs)))
    assert np.array_equal(a.table, b.table) and np.array_equal(a.bias, b.bias) and (a.temperature, a.least) == (b.temperature, b.least)


def test_quality_score_against_plain_version(spark, corpus):
    """A score is the sparse dot product of a text's n-gram shares with the weights."""
    texts, langs, good = corpus
    docs = documents(spark, texts[:200] + ODD_TEXTS)
    weights = quality.train(documents(spark, texts), spark.createDataFrame(list(enumerate(good)), "doc_id long, quality int"), F.lit(True))
    index = lambda h: max(int(h) >> (64 - quality.BITS), 1)
    wrap = (1 << 64) - 1
    mixed = lambda x: int(quality.mix(np.array([x & wrap], np.uint64))[0])

    def word_hash(w):
        raw = np.frombuffer(w, np.uint8)
        return int(quality.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])

    def plain(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", low)
        shares = Counter()
        letter = lambda c: 97 <= c <= 122 or c >= 128 or 48 <= c <= 57
        h = [word_hash(x) for x in w]
        for k, x in enumerate(w):
            shares[index(h[k])] += 1 / len(w)
            if k + 1 < len(w):
                shares[index(mixed(h[k] * int(quality._PAIR) + h[k + 1]))] += 1 / len(w)
                if h[k] == h[k + 1]:
                    shares[index(mixed(int(quality._SAME)))] += 1 / len(w)
            if not letter(x[-1]):
                before = x[-2] if len(x) > 1 else 0
                before = before if before < 97 or 122 < before < 128 else 0
                shares[index(mixed((x[-1] << 8 | before) + int(quality._END)))] += 1 / len(w)
        dot = weights[0] + sum(weights[b] * math.sqrt(32 * v) for b, v in shares.items())
        return 1 / (1 + math.exp(-dot))

    got = {r.doc_id: r.score for r in quality.score(docs, weights.astype(np.float32).astype(float)).collect()}
    for i, t in enumerate(texts[:200] + ODD_TEXTS):
        assert abs(got[i] - plain(t)) < 1e-4, i


def test_language_scores_against_plain_version(spark, corpus):
    """The average of a text's subword embeddings through the softmax, window by window."""
    texts, langs, _ = corpus
    model = langid.train(documents(spark, texts, langs=langs), F.lit(True))

    def plain(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        one = lambda part: langid.subwords(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0]
        # a string of 4 bytes has the 2-byte windows at 0, 1 and 2; its own stands second, beside that at 0
        rows = [model.table[one(low[k : k + 2])[0]] for k in range(len(low) - 1)]
        rows += [model.table[next(b for b in one(low[k : k + 4]) if b not in {one(low[j : j + 2])[0] for j in range(k, k + 3)})] for k in range(len(low) - 3)]
        logits = (np.mean(rows, axis=0, dtype=float) if rows else 0) + model.bias
        p = np.exp(logits / model.temperature - (logits / model.temperature).max())
        return p / p.sum()

    got = {r.doc_id: r for r in langid.predict(documents(spark, texts[:40]), model).collect()}
    for i in range(40):
        p = plain(texts[i])
        assert got[i].lang_pred == model.languages[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-4


def test_more_languages_than_rows_allow_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_MOST", 300)
    names = [f"l{k:03d}" for k in range(280)]
    texts = [f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 20 for k in range(280)]
    docs = documents(spark, texts * 2 + ["ab " * 700_000], langs=names * 2 + [None])
    model = langid.train(docs, F.lit(True))
    assert model.languages == names
    got = [r for r in langid.predict(docs, model).collect() if r.doc_id == 560]
    assert len(got) == 1 and got[0].lang_pred in names


def test_missing_and_repeated_ids(spark, corpus):
    texts, langs, good = corpus
    docs = documents(spark, texts[:100] + ["one text"] * 500, [*range(100), *[None] * 250, *[7] * 250], langs[:100] + ["en"] * 500)
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good[:100])] + [(7, 1), (7, 0)], "doc_id long, quality int")
    weights = quality.train(docs, labels, F.lit(True))
    assert len({r.score for r in quality.score(docs, weights).collect() if r.doc_id is None}) == 1
    assert quality.score(docs, weights).count() == langid.predict(docs, langid.train(docs, F.lit(True))).count() == 600
