"""Training samples are bounded in rows and in bytes, whatever the texts' lengths."""

import numpy as np
from pyspark.sql import functions as F

from tallywick.llm import langid, lm

from .texts import documents

MB = 1 << 20


def long_texts(spark, n):
    """Texts of 1 MB of two languages."""
    word = F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(k))) for k in range(8)])
    return spark.range(n, numPartitions=16).select(
        F.col("id").alias("doc_id"), F.substring(F.repeat(word, MB // 100), 1, MB).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang")
    )


def test_a_thousand_texts_of_one_mb(spark):
    docs = long_texts(spark, 1000)
    sample, last = lm.sampled(docs)
    assert sample.count() == lm.SAMPLE_BYTES // MB and sample.agg(F.max("d0")).first()[0] == last
    least = docs.select(F.xxhash64("doc_id").alias("d0")).orderBy("d0").limit(16)
    assert least.agg(F.max("d0")).first()[0] == last
    sample, languages = langid.sampled(docs)
    assert languages == ["a", "b"]
    # 2**15 shares of 8 bytes a text
    most = langid.TRAIN_BYTES // 2 // (8 << langid.BITS)
    assert {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {"a": min(500, most), "b": min(500, most)}


def test_few_bytes_keep_a_row_of_each_language(spark):
    docs = documents(spark, ["long " * 1000, "lang " * 1000, "text " * 1000] * 5, langs=["x", "y", "z"] * 5)
    sample, _ = langid.sampled(docs, train_bytes=1)
    assert sorted(r.lang for r in sample.collect()) == ["x", "y", "z"]
    sample, _ = lm.sampled(docs, sample_bytes=1)
    assert sample.count() == 1


def test_sample_is_the_plain_one(spark):
    """Against sorting, and adding up, in plain Python."""
    rng = np.random.default_rng(1)
    texts = ["w" * int(n) for n in rng.integers(0, 300, 200)]
    ids = [*range(150), *range(49), None]
    docs = documents(spark, texts, ids, [f"l{i % 3}" for i in range(200)])
    keyed = docs.select(F.xxhash64("doc_id").alias("d0"), F.col("doc_id").alias("d1"), F.xxhash64("text").alias("d2"), "lang", "text").collect()
    order = sorted(keyed, key=lambda r: (r.d0, r.d1 is not None, r.d1 or 0, r.d2))
    for rows, size in ((40, 10**9), (200, 3000), (200, 10**9)):
        held, want = 0, []
        for r in order[:rows]:
            if held >= size:
                break
            want.append((r.d0, r.d1, r.d2))
            held += len(r.text)
        got, last = lm.sampled(docs, rows, size)
        assert sorted(map(str, want)) == sorted(str((r.d0, r.d1, r.d2)) for r in got.collect()) and last == want[-1][0]
        wanted = set()
        for lang in ("l0", "l1", "l2"):
            held = 0
            # wholly equal rows count once here
            for r in list(dict.fromkeys(r for r in order if r.lang == lang))[:rows]:
                if held >= 8 * size // 3:
                    break
                wanted.add((lang, r.d0, r.d1, r.d2))
                held += 8 * 2 * len(r.text)
        got, _ = langid.sampled(docs, rows, 8 * size)
        assert wanted == {(r.lang, r.d0, r.d1, r.d2) for r in got.collect()}


def test_equal_rows_in_a_sample(spark):
    docs = documents(spark, ["same text here"] * 300 + ["another one"], [5] * 300 + [6], ["x"] * 301)
    assert lm.sampled(docs, 50)[0].count() == 50
    sample, _ = langid.sampled(docs)
    assert sorted(r.d1 for r in sample.collect()) == [5, 6]
    assert lm.sampled(docs.limit(0))[1] is None and langid.sampled(docs.limit(0))[1] == []
