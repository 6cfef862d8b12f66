"""Operator 6: language identification.

A text is the average of embeddings of its hashed subwords (2- and 4-byte
windows of the lower-cased bytes, within the text), followed by a linear softmax;
both are trained by stochastic gradient descent in numpy on a bounded sample,
``PER_LANGUAGE`` rows of least id hash for each language (fewer where there are
so many languages that all would have over ``TRAIN_MOST`` rows, or where the rows
would have over ``TRAIN_BYTES``, shared evenly by the languages; each language has
a row at least, and wholly equal rows count once).  A row goes to training as the
shares of its distinct subwords, 2**15 at most however long the text, so training
holds ``TRAIN_BYTES`` and a row of each language at most.  The same rows give the
same model, in whatever order and partitions they come.  A temperature is
fitted on a part of the sample kept out of training, and with it the score below
which a prediction counts as rejected (calibrated so that at most ``REJECT`` of
right predictions are).

``und`` with score 0 is for texts that are null or have no letter.  Rows without
lang aren't learned from; if none has any, everything is ``und``.  Rows with the
same id each keep a row; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import lower, slices, utf8, window_hashes

BITS, WIDTH = 15, 16
#: Rows of a language, and of all languages, to learn from; a hash bound lets this many times as many pass before they are ranked.
PER_LANGUAGE, TRAIN_MOST, CUT_TIMES = 800, 204_800, 3
#: Bytes of subwords and shares that go to training (8 for each distinct subword, of which a text has 2 for a byte at most).
TRAIN_BYTES = 256 << 20
EPOCHS, BATCH, RATE = 6, 32, 2.0
REJECT = 0.005
UNKNOWN = "und"
_PLAIN_LETTER = re.compile("[A-Za-z]")


def subwords(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword, first subword of each text and the total)."""
    buf = lower(buf)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    place, bucket = [], []
    for width in (2, 4):
        h = window_hashes(buf, width)
        at = np.flatnonzero(np.arange(len(h)) + width <= ends[: len(h)])
        place.append(at)
        bucket.append(((h[at] + np.uint64(width)) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - BITS))
    place, bucket = np.concatenate(place), np.concatenate(bucket).astype(np.int64)
    order = np.argsort(place, kind="stable")
    return bucket[order], np.searchsorted(place[order], offsets)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _hash_bound(share: float) -> int:
    """The 64-bit signed hash that about ``share`` of all ids stay below."""
    return min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))


class Model:
    """languages, the logits that each bucket adds, bias, temperature, least score."""

    def __init__(self, languages, table, bias, temperature=1.0, least=0.0):
        self.languages, self.table, self.bias, self.temperature, self.least = languages, table.astype(np.float32), bias, temperature, least

    def logits(self, buf, offsets) -> np.ndarray:
        bucket, first = subwords(buf, offsets)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            for k in range(len(self.languages)):
                out[some, k] = np.add.reduceat(self.table[:, k][bucket], first[some], dtype=np.float64)
        return out / np.maximum(n, 1)[:, None] + self.bias


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], seed: int = 0) -> Model:
    """Texts as (distinct buckets, their shares)."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    emb = rng.normal(0, 0.1, (1 << BITS, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, k)), np.zeros(k)
    order = rng.permutation(len(texts))
    tuned, learned = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(tuned):
        tuned = learned
    steps = max(1, EPOCHS * -(-len(learned) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        learned = rng.permutation(learned)
        for lo in range(0, len(learned), BATCH):
            own = learned[lo : lo + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = np.stack([share @ emb[b] for b, share in (texts[i] for i in own)])
            error = softmax(mean @ out + bias)
            error[np.arange(len(own)), y[own]] -= 1
            error /= len(own)
            back = error @ out.T
            out -= rate * mean.T @ error
            bias -= rate * error.sum(axis=0)
            for i, g in zip(own, back, strict=True):
                b, share = texts[i]
                emb[b] -= rate * 64 * share[:, None] * g
    model = Model(languages, emb @ out, bias)
    logits = np.stack([share @ model.table[b] for b, share in (texts[i] for i in tuned)]) + bias
    losses = [(-np.log(np.maximum(softmax(logits / t)[np.arange(len(tuned)), y[tuned]], 1e-12)).mean(), t) for t in np.geomspace(0.05, 5, 40)]
    model.temperature = min(losses)[1]
    p = softmax(logits / model.temperature)
    right = p.argmax(axis=1) == y[tuned]
    model.least = float(np.quantile(p.max(axis=1)[right], REJECT)) if right.any() else 1.0
    return model


KEY = ["d0", "d1", "d2"]


def sampled(known: DataFrame, per_language: int = PER_LANGUAGE, train_bytes: int = TRAIN_BYTES) -> tuple[DataFrame, list[str]]:
    """(``KEY``, lang and text of the rows to learn from, all languages).  Rows are
    ranked by key and size alone; a text moves only once it is chosen."""
    keyed = known.select(F.xxhash64("doc_id").alias("d0"), F.col("doc_id").alias("d1"), F.xxhash64("text").alias("d2"), "lang", "text")
    # one row for each language
    seen = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min("d0").alias("least")).collect()
    languages = sorted(r.lang for r in seen)
    if not languages:
        return keyed.limit(0), languages
    each = max(1, min(per_language, TRAIN_MOST // len(languages)))
    # a language's rows of small id hash, several times as many as are ranked; its least hash stays even if all its rows share one id
    bounds = F.create_map(*[F.lit(x) for r in seen for x in (r.lang, max(r.least, _hash_bound(CUT_TIMES * each / r["count"])))])
    size = 8 * F.least(F.lit(1 << BITS), 2 * F.octet_length("text"))
    near = keyed.where(F.col("d0") <= bounds[F.col("lang")])
    ranked = near.groupBy("lang", *KEY).agg(F.max(size).alias("size"))
    before = Window.partitionBy("lang").orderBy(*KEY)
    held = F.coalesce(F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = ranked.withColumn("rank", F.row_number().over(before)).withColumn("held", held).where((F.col("rank") <= each) & (F.col("held") < max(1, train_bytes // len(languages))))
    # one row for each language again: its last key
    last = chosen.groupBy("lang").agg(F.max(F.struct(*KEY)).alias("key")).collect()
    least = lambda k: F.create_map(*[x for r in last for x in (F.lit(r.lang), F.lit(r.key[k]))])[F.col("lang")]
    upto = F.struct(*KEY) <= F.struct(*[least(k).alias(c) for k, c in enumerate(KEY)])
    return near.where(upto).dropDuplicates(["lang", *KEY]), languages


def train(docs: DataFrame, keep: Column, per_language: int = PER_LANGUAGE, train_bytes: int = TRAIN_BYTES) -> Model | None:
    """A model from rows of ``docs`` with a lang for which ``keep`` (over doc_id)
    is true: at most ``per_language`` rows of a language, ``TRAIN_MOST`` rows and
    about ``train_bytes`` in all, which go to one training task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    sample, languages = sampled(rows.where(F.col("lang").isNotNull() & F.coalesce(keep, F.lit(False))), per_language, train_bytes)
    if not languages:
        return None
    number = {g: k for k, g in enumerate(languages)}

    def shares(batches):
        for whole in batches:
            for part in slices(whole, "text"):
                bucket, first = subwords(*utf8(part.column("text")))
                out = []
                for k in range(len(part)):
                    b, n = np.unique(bucket[first[k] : first[k + 1]], return_counts=True)
                    out.append((b.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lang", *KEY)), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["lang", *KEY, "buckets", "counts"])

    def learn(table: pa.Table) -> pa.Table:
        texts, y = [], []
        table = table.sort_by([(c, "ascending") for c in ("lang", *KEY)])
        for lang, b, n in zip(table.column("lang").to_pylist(), table.column("buckets").to_pylist(), table.column("counts").to_pylist(), strict=True):
            if b:
                n = np.frombuffer(n, np.int32)
                texts.append((np.frombuffer(b, np.int32).astype(np.int64), n / n.sum()))
                y.append(number[lang])
        if not texts:
            texts, y = [(np.zeros(1, np.int64), np.ones(1))], [0]
        m = fit(texts, np.array(y), languages)
        return pa.table({"table": [m.table.tobytes()], "bias": [m.bias.tobytes()], "temperature": [float(m.temperature)], "least": [m.least]})

    sample = sample.mapInArrow(shares, "lang string, d0 long, d1 long, d2 long, buckets binary, counts binary")
    got = sample.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: learn(t), "table binary, bias binary, temperature double, least double").first()
    if got is None:
        return None
    table = np.frombuffer(bytes(got.table), np.float32).reshape(-1, len(languages))
    return Model(languages, table, np.frombuffer(bytes(got.bias)), got.temperature, got.least)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected (the score is below the calibrated
    least score, or there is no letter) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats for each language

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                col = batch.column(1)
                texts = col.to_pylist()
                lettered = np.array([bool(t) and (_PLAIN_LETTER.search(t) is not None or any(map(str.isalpha, t))) for t in texts], bool)
                if m is None:
                    lettered[:] = False
                    best, top = np.zeros(len(texts), int), np.zeros(len(texts))
                else:
                    p = softmax(m.logits(*utf8(col)) / m.temperature)
                    best, top = p.argmax(axis=1), p.max(axis=1)
                pred = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                top = np.where(lettered, top, 0.0)
                least = m.least if m else 1.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(top), pa.array(~lettered | (top < least))], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
