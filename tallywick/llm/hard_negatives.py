"""Operator 11: hard negatives by blocked dense products.

Scores are inner products of integer vectors: each component x of a row becomes
floor(256*x).  Blocks of anchors are broadcast and multiplied with blocks of
candidates in float64, which is exact below 2**53.  A first pass keeps the best
rows of the anchor's own label (mergeable: each task keeps its own best, the best
of these are the best of all); a second pass looks for each (anchor, positive) in
the rows of other labels whose score lies between ``LOW`` and ``HIGH`` hundredths
of the positive's.  Anchors come in passes of ``PASS_BYTES``, so what is broadcast
has a bound; nothing else leaves the tasks but each one's best rows.

A task takes its candidates by ascending id, so that of equal scores the earlier
one stays and only strictly better rows are looked at: a vector that a third of
all rows share costs no more than others.

Rows with a null label, a null vector or a null or non-finite component take no
part.  A null id is no anchor, its label stays, and it comes last among ties.
Vectors of unequal lengths are compared as if zeros followed the shorter one.
Rows with equal id, label and vector are rows of their own: each has its anchor's
rows, and each may be the other's positive.  Where 2**53 could be passed, the same
steps run on Python integers; scores beyond a long are given as the nearest long.
An anchor without another row of its label, and a positive without a row in its
window, give no rows.  Further columns are ignored, clashing names included; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import one_thread

ANCHOR_MOD, MOVE_MOD, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
PASS_BYTES = 1 << 25
BLOCK_ROWS, BLOCK_ANCHORS = 1024, 512
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def vectors(col: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(whether a row takes part, its integer vector as float64), cut or filled
    with zeros to ``dims`` components (None: the longest)."""
    n = len(col)
    lens = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)).astype(np.int64)
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ok = np.asarray(col.is_valid())
    finite = np.isfinite(values)
    row = np.repeat(np.arange(n), lens)
    ok[row[~finite]] = False
    dims = int(lens.max(initial=0)) if dims is None else dims
    values = np.floor(256 * np.where(finite, values, 0))
    if n and (lens == dims).all():
        return ok, values.reshape(n, dims)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
    out = np.zeros((n, dims))
    inside = at < dims
    out[row[inside], at[inside]] = values[inside]
    return ok, out


def whole(v: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)


class Best:
    """The best ``most`` rows of each slot so far, by descending score; of equal
    scores the one that came first.  Slots are windows of scores of anchors."""

    def __init__(self, slots: int, most: int, exact: bool):
        self.most, self.kind = most, np.dtype(object if exact else np.float64)
        self.slot, self.id, self.known, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, self.kind)
        self.twin = np.zeros(0, bool)
        self.full = np.zeros(slots, bool)
        self.least = np.zeros(slots, self.kind)  # of a full slot, the score to beat

    def add(self, slot, ids, known, score, twin) -> None:
        parts = [np.concatenate(p) for p in ((self.slot, slot), (self.id, ids), (self.known, known), (self.score, score), (self.twin, twin))]
        order = np.argsort(-parts[3], kind="stable")
        order = order[np.argsort(parts[0][order], kind="stable")]
        s = parts[0][order]
        rank = np.arange(len(s)) - np.searchsorted(s, s)
        self.slot, self.id, self.known, self.score, self.twin = (p[order[rank < self.most]] for p in parts)
        last = order[rank == self.most - 1]
        self.full[parts[0][last]] = True
        self.least[parts[0][last]] = parts[3][last]


def _candidates(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions(F.col("vec_id").asc_nulls_last())


def _blocks(batches, dims: int, exact: bool):
    """(ids, whether known, labels, vectors) of candidate blocks: small ones
    first, so that there is soon a score to beat."""
    size = 32
    for batch in batches:
        ok, v = vectors(batch.column(2), dims)
        ok &= np.asarray(batch.column(1).is_valid())
        at = np.flatnonzero(ok)
        ids = np.asarray(pa.compute.fill_null(batch.column(0), 0))[at]
        known = np.asarray(batch.column(0).is_valid())[at]
        labels, v = np.asarray(pa.compute.fill_null(batch.column(1), 0))[at], v[at]
        i = 0
        while i < len(at):
            j = i + size
            yield ids[i:j], known[i:j], labels[i:j], whole(v[i:j]) if exact else v[i:j]
            i, size = j, min(2 * size, BLOCK_ROWS)


def _emitted(best: Best, slots: np.ndarray) -> pa.RecordBatch:
    top = (1 << 63) - 1
    score = [max(-top, min(top, int(s))) for s in best.score]
    return pa.RecordBatch.from_arrays(
        [pa.array(slots[best.slot]), pa.array(best.id, mask=~best.known), pa.array([str(int(s)) for s in best.score]), pa.array(score, pa.int64()), pa.array(best.twin)],
        ["slot", "id", "exact", "score", "twin"],
    )


_PART = "slot long, id long, exact string, score long, twin boolean"


def _ranked(parts: DataFrame, most: int, exact: bool) -> DataFrame:
    """The best ``most`` rows of each slot over all tasks, with their place."""
    by = F.col("exact").cast("decimal(38,0)") if exact else F.col("score")
    order = Window.partitionBy("slot").orderBy(by.desc(), F.col("id").asc_nulls_last())
    return parts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hard_negatives(
    rows: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    pass_bytes: int = PASS_BYTES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): of each anchor and positive the best ``negatives`` rows of
    another label with low*positive_score <= 100*negative_score <=
    high*positive_score.

    Counts of rows and each pass' anchors and positives are jobs of this call;
    the negatives are a lazy result."""
    spark = rows.sparkSession
    label = F.col(label_col).cast("long")
    rows = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(id_col) % MOVE_MOD == 0, (label + 1) % LABELS).otherwise(label).alias("label"), F.col(vector_col).alias("vector")
    )

    def measure(batches):
        for batch in batches:
            ok, v = vectors(batch.column(2))
            ids = np.asarray(pa.compute.fill_null(batch.column(0), 1))
            anchor = ok & np.asarray(batch.column(1).is_valid()) & (ids % ANCHOR_MOD == 0)
            yield pa.RecordBatch.from_arrays([pa.array([int(anchor.sum())]), pa.array([v.shape[1]]), pa.array([float(np.abs(v[ok]).max(initial=0))])], ["anchors", "dims", "largest"])

    seen = rows.mapInArrow(measure, "anchors long, dims long, largest double").agg(F.sum("anchors"), F.max("dims"), F.max("largest")).first()
    n, dims, largest = seen[0] or 0, seen[1] or 0, seen[2] or 0.0
    exact = dims * largest * largest >= 2.0**53

    def anchor_rows(batches):
        for batch in batches:
            ok, v = vectors(batch.column(2), dims)
            at = np.flatnonzero(ok & np.asarray(batch.column(1).is_valid()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([v[i].tobytes() for i in at], pa.binary())], ["vec_id", "label", "v"])

    anchors = rows.where(F.col("vec_id") % ANCHOR_MOD == 0).mapInArrow(anchor_rows, "vec_id long, label long, v binary").groupBy("vec_id", "label", "v").count()
    passes = max(1, -(-n * 8 * max(dims, 1) // pass_bytes))
    found = None
    for k in range(passes):
        some = anchors if passes == 1 else anchors.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(passes)) == k)
        part = _one_pass(spark, rows, some, dims, exact, positives, negatives, low, high)
        found = part if found is None or part is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], OUT)


def _one_pass(spark, rows, anchors, dims, exact, positives, negatives, low, high) -> DataFrame | None:
    """The rows of some anchors, which fit into ``PASS_BYTES``."""
    held = anchors.toArrow().sort_by([("label", "ascending"), ("vec_id", "ascending"), ("v", "ascending")])
    if not held.num_rows:
        return None
    ids, labels, copies = (np.asarray(held.column(c)) for c in ("vec_id", "label", "count"))
    v = np.frombuffer(b"".join(held.column("v").to_pylist()), np.float64).reshape(len(ids), dims)
    sent = spark.sparkContext.broadcast((ids, labels, copies, v))

    def same_label(batches):
        one_thread()
        ids, labels, _, v = sent.value
        v = whole(v) if exact else v
        groups = [(x, int(i), int(j)) for x, i, j in zip(np.unique(labels), np.searchsorted(labels, np.unique(labels)), np.searchsorted(labels, np.unique(labels), "right"), strict=True)]
        best = Best(len(ids), positives + 1, exact)
        for c_ids, known, c_labels, c in _blocks(batches, dims, exact):
            for x, first, last in groups:
                of = np.flatnonzero(c_labels == x)
                for i in range(first, last if len(of) else first, BLOCK_ANCHORS):
                    j = min(last, i + BLOCK_ANCHORS)
                    s = c[of] @ v[i:j].T
                    row, col = np.nonzero(~best.full[i:j] | (s > best.least[i:j]))
                    if len(row):
                        r, a = of[row], i + col
                        twin = known[r] & (c_ids[r] == ids[a])
                        twin[twin] = (c[r[twin]] == v[a[twin]]).all(1)
                        best.add(a, c_ids[r], known[r], s[row, col], twin)
        yield _emitted(best, np.arange(len(ids)))

    candidates = _candidates(rows)
    near = _ranked(candidates.mapInArrow(same_label, _PART), positives + 1, exact)
    # an anchor is no positive of its own: one of its equals goes
    own = Window.partitionBy("slot", "twin").orderBy("place")
    near = near.withColumn("_own", F.col("twin") & (F.row_number().over(own) == 1)).where("NOT _own")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy("place"))).where(F.col("place") <= positives)
    # at most ``positives`` rows of each anchor of this pass
    near = near.select("slot", "id", "exact").toArrow().to_pylist()
    if not near:
        return None
    near.sort(key=lambda r: (r["slot"], -int(r["exact"])))
    at = np.array([r["slot"] for r in near], np.int64)
    level = np.array([int(r["exact"]) for r in near], object)
    # hundredths of a positive's score as bounds of whole scores
    below, above = np.array([-(-low * p // 100) for p in level], object), np.array([high * p // 100 for p in level], object)
    if not exact:
        below, above = below.astype(np.float64), above.astype(np.float64)
    place = np.arange(len(at)) - np.searchsorted(at, at)
    windows = spark.sparkContext.broadcast((at, place, below, above, level, [r["id"] for r in near]))

    def other_label(batches):
        one_thread()
        ids, labels, copies, v = sent.value
        v = whole(v) if exact else v
        at, place, below, above, level, positive = windows.value
        best = Best(len(at), negatives, exact)
        spans = []
        for i in range(0, len(ids), BLOCK_ANCHORS):
            j = min(len(ids), i + BLOCK_ANCHORS)
            first, last = np.searchsorted(at, [i, j])
            # of each place the slots of this block, and the anchor's column of each
            spans.append((i, j, [slots for p in range(positives) if len(slots := first + np.flatnonzero(place[first:last] == p))]))
        for c_ids, known, c_labels, c in _blocks(batches, dims, exact):
            for i, j, by_place in spans:
                s = c @ v[i:j].T
                other = c_labels[:, None] != labels[None, i:j]
                for slots in by_place:
                    cols = at[slots] - i
                    t = s if len(cols) == j - i else s[:, cols]
                    allowed = other if len(cols) == j - i else other[:, cols]
                    floor = np.where(best.full[slots], best.least[slots], below[slots] - 1)
                    row, col = np.nonzero((t > floor) & (t <= above[slots]) & allowed)
                    if len(row):
                        best.add(slots[col], c_ids[row], known[row], t[row, col], np.zeros(len(row), bool))
        out = _emitted(best, np.arange(len(at)))
        of = at[best.slot]
        top = (1 << 63) - 1
        more = [pa.array(ids[of]), pa.array([positive[k] for k in best.slot], pa.int64()), pa.array([max(-top, min(top, int(level[k]))) for k in best.slot], pa.int64()), pa.array(copies[of])]
        yield pa.RecordBatch.from_arrays([*out.columns, *more], [*out.schema.names, "anchor_id", "positive_id", "positive_score", "copies"])

    far = _ranked(candidates.mapInArrow(other_label, f"{_PART}, anchor_id long, positive_id long, positive_score long, copies long"), negatives, exact)
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")
    return far.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), each).drop("_copy")
