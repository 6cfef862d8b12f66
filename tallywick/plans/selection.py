"""Exact order statistics of any number of rows.

A value's place is found by counting: the range that holds the wanted rank is cut
into ``BUCKETS``, tasks count their rows in each, and the bucket of the rank is the
next range, until it holds ``GATHER`` rows at most (these are collected) or one
value (which is the answer, however many rows have it).  All columns and ranks
share their passes.  No task keeps more than the counts, and the driver gets the
counts of the ranges and at most ``GATHER`` values of each.

Doubles are compared as integers of the same order, so a range of any width ends
in a few passes: each cuts it by 4,096, and most need two at 10^9 rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GATHER = 1 << 16
BUCKETS = 1 << 12
_LOW63 = (1 << 63) - 1
_MASK = (1 << 64) - 1


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keeps narrow rows on the executors while several passes read them; what an
    executor loses is computed again."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def key_of(df: DataFrame, name: str) -> Column:
    """The column as a long or double of the same order (decimals of more than 18
    digits by their double)."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return c.cast("double")


def in_order(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers (its own inverse on the bits)."""
    if x.dtype != np.float64:
        return x.astype(np.int64)
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & _LOW63)


def number_of(key: int, is_double: bool):
    if not is_double:
        return key
    bits = np.int64(key)
    return float(np.array([bits ^ ((bits >> np.int64(63)) & np.int64(_LOW63))]).view(np.float64)[0])


def _keys(col: pa.Array) -> np.ndarray:
    """Keys of a long or double column without nulls and NaN."""
    x = col.drop_null().to_numpy(zero_copy_only=False)
    return in_order(x[~np.isnan(x)] if x.dtype == np.float64 else x)


def _bucket(x: np.ndarray, lo: int, width: int) -> np.ndarray:
    """Bucket numbers of 64-bit keys that are not below ``lo``."""
    return ((x.view(np.uint64) - np.uint64(lo & _MASK)) // np.uint64(width)).astype(np.int64)


def _width(lo: int, hi: int) -> int:
    return -(-(hi - lo + 1) // BUCKETS)


@dataclass(frozen=True)
class Span:
    """A range of keys that holds a wanted rank, and the rows below and in it."""

    column: int
    rank: int
    lo: int
    hi: int
    below: int
    count: int

    def narrowed(self, counts: dict[int, int]) -> Span:
        width, seen = _width(self.lo, self.hi), self.below
        for b in sorted(counts):
            if seen + counts[b] > self.rank:
                lo = self.lo + b * width
                return replace(self, lo=lo, hi=min(self.hi, lo + width - 1), below=seen, count=counts[b])
            seen += counts[b]
        raise AssertionError("the rows have changed between passes")


@dataclass(frozen=True)
class Place:
    """A value, how many rows are less, how many equal."""

    value: float | int
    less: int
    equal: int


class Selector:
    """Order statistics of columns of ``df``, which are longs or doubles; nulls
    and NaN don't count."""

    def __init__(self, df: DataFrame, columns: list[str], gather: int | None = None):
        self.columns, self.gather = columns, GATHER if gather is None else gather
        self.rows = df.select(*[F.col(f"`{c}`") for c in columns])
        self.double = [isinstance(f.dataType, T.DoubleType) for f in self.rows.schema.fields]

        def measure(batches):
            for batch in batches:
                for k, col in enumerate(batch.columns):
                    x = _keys(col)
                    if len(x):
                        yield pa.RecordBatch.from_pydict({"c": [k], "n": [len(x)], "lo": [int(x.min())], "hi": [int(x.max())]})

        found = self.rows.mapInArrow(measure, "c long, n long, lo long, hi long").groupBy("c").agg(F.sum("n"), F.min("lo"), F.max("hi")).collect()
        self.extent = {r[0]: tuple(r[1:]) for r in found}

    def count(self, column: str) -> int:
        return self.extent.get(self.columns.index(column), (0,))[0]

    def places(self, wanted: list[tuple[str, int]]) -> list[Place]:
        """The value at each (column, rank from 0)."""
        spans = []
        for name, rank in wanted:
            c = self.columns.index(name)
            n, lo, hi = self.extent.get(c, (0, 0, 0))
            if not 0 <= rank < n:
                raise ValueError(f"rank {rank} of {n} values of {name}")
            spans.append(Span(c, rank, lo, hi, 0, n))
        while open_ := sorted({(s.column, s.lo, s.hi) for s in spans if s.count > self.gather and s.lo < s.hi}):
            counts = self._counted(open_)
            spans = [s.narrowed(counts[open_.index((s.column, s.lo, s.hi))]) if (s.column, s.lo, s.hi) in open_ else s for s in spans]
        ranges = sorted({(s.column, s.lo, s.hi) for s in spans if s.lo < s.hi})
        values = self._gathered(ranges) if ranges else {}
        out = []
        for s in spans:
            is_double = self.double[s.column]
            if s.lo == s.hi:
                out.append(Place(number_of(s.lo, is_double), s.below, s.count))
                continue
            x = values[ranges.index((s.column, s.lo, s.hi))]
            key = x[s.rank - s.below]
            first, last = np.searchsorted(x, key), np.searchsorted(x, key, "right")
            out.append(Place(number_of(int(key), is_double), s.below + int(first), int(last - first)))
        return out

    def _counted(self, ranges: list[tuple[int, int, int]]) -> list[dict[int, int]]:
        def count(batches):
            total = np.zeros((len(ranges), BUCKETS), np.int64)
            for batch in batches:
                keys = {c: _keys(batch.column(c)) for c in {c for c, _, _ in ranges}}
                for t, (c, lo, hi) in enumerate(ranges):
                    x = keys[c]
                    x = x[(x >= lo) & (x <= hi)]
                    total[t] += np.bincount(_bucket(x, lo, _width(lo, hi)), minlength=BUCKETS)
            t, b = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"t": t, "b": b, "n": total[t, b]})

        out = [{} for _ in ranges]
        for t, b, n in self.rows.mapInArrow(count, "t long, b long, n long").groupBy("t", "b").agg(F.sum("n")).collect():
            out[t][b] = n
        return out

    def _gathered(self, ranges: list[tuple[int, int, int]]) -> dict[int, np.ndarray]:
        def gather(batches):
            for batch in batches:
                for t, (c, lo, hi) in enumerate(ranges):
                    x = _keys(batch.column(c))
                    x = x[(x >= lo) & (x <= hi)]
                    if len(x):
                        yield pa.RecordBatch.from_pydict({"t": np.full(len(x), t), "x": x})

        found = self.rows.mapInArrow(gather, "t long, x long").toArrow()
        t, x = (np.asarray(found.column(k).combine_chunks()) for k in ("t", "x"))
        order = np.lexsort((x, t))
        t, x = t[order], x[order]
        return {k: x[np.searchsorted(t, k) : np.searchsorted(t, k, "right")] for k in range(len(ranges))}


def percentiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact percentiles with linear interpolation; null and NaN are left out, and
    a column without values has None."""
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in wanted])
    with kept(rows) as held:
        chosen = Selector(held, list(wanted))
        at = {(c, q): (chosen.count(c) - 1) * q for c, qs in wanted.items() for q in qs if chosen.count(c)}
        ranks = sorted({(c, r) for (c, _), p in at.items() for r in (math.floor(p), math.ceil(p))})
        value = {k: p.value for k, p in zip(ranks, chosen.places(ranks), strict=True)}

    def between(c: str, p: float) -> float:
        low, high = math.floor(p), math.ceil(p)
        return value[c, low] if low == high else (high - p) * value[c, low] + (p - low) * value[c, high]

    return {c: [between(c, at[c, q]) if (c, q) in at else None for q in qs] for c, qs in wanted.items()}


@dataclass(frozen=True)
class TextSpan:
    """A range of eight-byte pieces after a known beginning."""

    head: bytes
    lo: int
    hi: int
    rank: int
    count: int


def nth_texts(df: DataFrame, text: str, keys: list[str], wanted: list[tuple[str, float | int | None, int, int]], gather: int | None = None) -> list[str]:
    """For each (key column, value or None, rank, rows): of the so many rows whose
    key has that value (None: is null) the text at that rank, in order of bytes."""
    most = GATHER if gather is None else gather
    rows = df.select(F.encode(F.col(f"`{text}`").cast("string"), "utf-8").alias("_text"), *[F.col(f"`{c}`") for c in keys])

    def chosen(batch: pa.RecordBatch, k: int) -> pa.Array:
        name, value, _, _ = wanted[k]
        col = batch.column(1 + keys.index(name))
        mask = pa.compute.is_null(col) if value is None else pa.compute.fill_null(pa.compute.equal(col, pa.scalar(value, col.type)), False)
        return batch.column(0).filter(mask)

    def pieces(texts: pa.Array, span: TextSpan) -> tuple[np.ndarray, list[bytes]]:
        own = [t for t in texts.to_pylist() if t is not None and t.startswith(span.head)]
        x = np.array([t[len(span.head) : len(span.head) + 8] for t in own], "S8").view(">u8").astype(np.uint64).ravel() if own else np.zeros(0, np.uint64)
        inside = (x >= np.uint64(span.lo)) & (x <= np.uint64(span.hi))
        return x[inside], [t for t, i in zip(own, inside.tolist(), strict=True) if i]

    spans = [TextSpan(b"", 0, _MASK, rank, n) for _, _, rank, n in wanted]
    answers: dict[int, bytes] = {}
    while open_ := [k for k, s in enumerate(spans) if k not in answers and s.count > most]:
        now = [spans[k] for k in open_]

        def count(batches, now=now, open_=open_):
            total = np.zeros((len(now), BUCKETS), np.int64)
            for batch in batches:
                for t, s in enumerate(now):
                    x, _ = pieces(chosen(batch, open_[t]), s)
                    total[t] += np.bincount(_bucket(x, s.lo, _width(s.lo, s.hi)), minlength=BUCKETS)
            t, b = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"t": t, "b": b, "n": total[t, b]})

        found = rows.mapInArrow(count, "t long, b long, n long").groupBy("t", "b").agg(F.sum("n")).collect()
        for t, k in enumerate(open_):
            s, seen = spans[k], 0
            width = _width(s.lo, s.hi)
            for b, n in sorted((r[1], r[2]) for r in found if r[0] == t):
                if seen + n > s.rank:
                    lo = s.lo + b * width
                    s = TextSpan(s.head, lo, min(s.hi, lo + width - 1), s.rank - seen, n)
                    break
                seen += n
            if s.lo == s.hi:  # one piece: all of these texts go on behind it, or end
                piece = s.lo.to_bytes(8, "big")
                if piece.endswith(b"\0"):
                    answers[k] = s.head + piece.rstrip(b"\0")
                s = TextSpan(s.head + piece, 0, _MASK, s.rank, s.count)
            spans[k] = s
    if rest := [k for k in range(len(spans)) if k not in answers]:

        def own_texts(batches):
            for batch in batches:
                for k in rest:
                    _, own = pieces(chosen(batch, k), spans[k])
                    if own:
                        yield pa.RecordBatch.from_pydict({"t": np.full(len(own), k), "x": pa.array(own, pa.binary())})

        texts: dict[int, list[bytes]] = {k: [] for k in rest}
        for r in rows.mapInArrow(own_texts, "t long, x binary").toArrow().to_pylist():
            texts[r["t"]].append(r["x"])
        answers |= {k: sorted(texts[k])[spans[k].rank] for k in rest}
    return [answers[k].decode() for k in range(len(spans))]
