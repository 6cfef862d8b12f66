"""Vectorised text kernels over Arrow string columns.

They work on the UTF-8 buffer of a whole batch at once, so that the only
per-row Python is in the operators that call into a per-text library.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = {"b": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, n of each."""
    if len(_POW["b"]) < n:
        m = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("b", _BASE), ("i", inverse)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["b"][:n], _POW["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(1)
def one_thread() -> None:
    """Matrix products of a task use its own core alone: Spark runs a task on
    every core, and threads that wait for each other double its time."""
    for lib in (Path(np.__file__).resolve().parents[1] / "numpy.libs").glob("*openblas*"):
        blas = ctypes.CDLL(str(lib))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(blas, name):
                getattr(blas, name)(1)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about ``limit`` bytes of text each (one row
    at least), so that a kernel's arrays stay small whatever a batch holds."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[buf]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of the runs of
    bytes other than space and x09-x0D; no word crosses documents."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    gap = SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, the same for equal bytes anywhere."""
    power, inverse = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def window_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of ``width`` bytes (a power of two)."""
    h = buf.astype(np.uint64) + np.uint64(1)
    base, w = _BASE, 1
    while w < width:
        if len(h) <= w:
            return np.zeros(0, np.uint64)
        h = h[:-w] * base + h[w:]
        base = np.uint64(int(base) * int(base) & 0xFFFFFFFFFFFFFFFF)
        w *= 2
    return h
