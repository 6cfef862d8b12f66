"""Operator 2: quality classifier on hashed word n-grams.

Features are hashes of lower-cased words, of pairs of neighbours, of word ends
in punctuation, and of the mark that a word repeats the one before; each kind
counts relative to its number in the text.  Logistic regression is trained with
follow-the-regularised-leader updates (per-coordinate rates, L1 and L2) in
several shards of a bounded, hash-ordered sample of labelled rows, and the
shards' weights are averaged.  A score is the sparse dot product of a whole
text with the weights.

Labels, lang, source and id are never inputs of a score.  A null or empty text
has no feature: its score is that of the bias.  Null labels aren't learned from;
of several labels of one id the least counts, and of several rows of one id the
one of least text hash is learned from.  The same rows give the same weights, in
whatever order and partitions they come.  Rows with the same id each keep a row; without any label every score is 0.5; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import lower, mix, slices, span_hashes, utf8, words

#: Feature space; the most labelled rows to learn from; shards and epochs.
BITS, TRAIN_MOST, SHARDS, EPOCHS = 18, 24_000, 12, 3
#: FTRL: rate, smoothing, L1, L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
THRESHOLD = 0.3
_SAME, _PAIR, _END, _BIAS = np.uint64(0x51), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0


def features(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of every feature occurrence; values of a kind sum
    to 1 over a text, but for the mark of repeats, whose values sum to the share
    of repeating words."""
    buf = lower(buf)
    starts, ends, first = words(buf, offsets)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    h = span_hashes(buf, starts, ends)
    share = 1.0 / np.maximum(n, 1)
    shift = np.uint64(64 - bits)
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    same = pair[h[pair] == h[pair + 1]]
    last = buf[ends - 1] if len(ends) else buf[:0]
    odd = np.flatnonzero(((last < 97) | ((last > 122) & (last < 128))) & ((last < 48) | (last > 57)))
    before = np.where(ends[odd] - 2 >= starts[odd], buf[np.maximum(ends[odd] - 2, 0)], 0).astype(np.uint64)
    end = mix((last[odd].astype(np.uint64) << np.uint64(8) | np.where((before < 97) | ((before > 122) & (before < 128)), before, np.uint64(0))) + _END)
    two = mix(h[pair] * _PAIR + h[pair + 1])
    marks = np.full(len(same), mix(np.array([_SAME]))[0])
    who = np.concatenate([text, text[pair], text[odd], text[same]])
    bucket = np.concatenate([h, two, end, marks]) >> shift
    value = np.concatenate([share[text], share[text[pair]], share[text[odd]], share[text[same]]])
    return who, np.maximum(bucket.astype(np.int64), 1), value  # bucket 0 is the bias


class Ftrl:
    """FTRL-proximal logistic regression."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def _rows(buf, offsets, scale=32.0):
    """Each text's distinct buckets and values, the bias among them."""
    who, bucket, value = features(buf, offsets)
    key, at = np.unique(who * (1 << BITS) + bucket, return_inverse=True)
    value = np.bincount(at, value, len(key))
    who = key >> BITS
    cut = np.searchsorted(who, np.arange(len(offsets)))
    for k in range(len(offsets) - 1):
        own = slice(cut[k], cut[k + 1])
        yield np.append(key[own] & ((1 << BITS) - 1), _BIAS), np.append(np.sqrt(value[own] * scale), 1.0)


def _train(table: pa.Table) -> pa.Table:
    # rows arrive in any order: a fixed one makes the weights the same on every run
    table = table.sort_by([("dice", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    examples = []
    for batch in table.to_batches():
        for part in slices(batch, "text"):
            examples += zip(_rows(*utf8(part.column("text"))), part.column("label").to_pylist(), strict=True)
    model, order = Ftrl(), np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            (i, x), y = examples[k]
            model.learn(i, x, y)
    w = model.weights(slice(None))
    used = np.flatnonzero(w)
    return pa.table({"bucket": pa.array(used, pa.int32()), "weight": pa.array(w[used], pa.float64())})


def train(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "quality", train_most: int = TRAIN_MOST) -> np.ndarray:
    """Weights from the labelled rows of ``docs`` for which ``keep`` (over
    doc_id) is true: at most ``train_most``, those of least id hash."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col(label_col) > 0).cast("int")).alias("label"))
    chosen = known.where(keep).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # train_most rows of two numbers at most: the broadcast is bounded
    sample = rows.join(F.broadcast(chosen), "doc_id")
    # of several rows with one id the one of least text hash, so that train_most bounds rows too
    sample = sample.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("m"))
    sample = sample.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("doc_id").alias("dice"), "doc_id", "label", "m.text")
    shards = sample.groupBy("shard").applyInArrow(_train, "bucket int, weight double")
    # SHARDS numbers of a bucket, added in their order
    total = shards.groupBy("bucket").agg(F.aggregate(F.array_sort(F.collect_list("weight")), F.lit(0.0), lambda a, x: a + x).alias("weight"), F.count("*").alias("n"))
    weights = np.zeros(1 << BITS)
    found = total.toPandas()  # 2**BITS rows at most
    if len(found):
        weights[found["bucket"].to_numpy()] = found["weight"].to_numpy() / max(1, int(found["n"].max()))
    return weights


def scores_of(weights: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    who, bucket, value = features(buf, offsets)
    key, at = np.unique(who * (1 << BITS) + bucket, return_inverse=True)
    value = np.sqrt(np.bincount(at, value, len(key)) * 32.0)
    dot = np.bincount(key >> BITS, weights[key & ((1 << BITS) - 1)] * value, len(offsets) - 1) + weights[_BIAS]
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the carried columns, score and predicted of every row."""
    carry = [c for c in (carry or []) if c not in ("doc_id", "score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 1 MB

    def run(batches):
        w = shared.value.astype(np.float64)
        for whole in batches:
            for batch in slices(whole, "_text"):
                s = scores_of(w, *utf8(batch.column(batch.schema.get_field_index("_text"))))
                kept = batch.drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*kept.schema.names, "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as
    they are."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w = shared.value.astype(np.float64)
        for whole in batches:
            for batch in slices(whole, text_col):
                s = scores_of(w, *utf8(batch.column(batch.schema.get_field_index(text_col))))
                yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
