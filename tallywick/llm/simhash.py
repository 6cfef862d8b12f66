"""Operator 8: SimHash near-duplicates through deletion-variant signatures.

Each of the 64 bits is set where over half of a document's shingle hashes have
it.  Fingerprints link at ``BITS`` = 3 or fewer differing bits.  Cut into two
halves, one half of a linked pair differs in at most one bit, so the halves, and
the halves with one bit made a wildcard, are indexed; equal keys meet in a
shuffle and the pairs among them are verified.

Exact copies collapse before that: the index holds distinct fingerprints.  A
key's members come sorted from the shuffle and leave as a spanning forest, never
as all pairs.  A key with over ``GROUP`` members isn't compared in its task: its
members are indexed again by one-wildcard variants of the quarters of the other
half.  The forest's components come from alternating large-star and small-star
rounds.

A null or empty text has fingerprint zero, which links like any other.  Rows
with the same id each keep a row; a null id never names a component unless it
has no other; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import SPACE, lower, slices, utf8, words
from .shared import written

SHINGLE, SEED, BITS, GROUP = 3, 42, 3, 1024


def fingerprints_of(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprints of the texts in a UTF-8 buffer."""
    from xxhash import xxh64_intdigest

    buf = lower(buf)
    starts, ends, first = words(buf, offsets)
    # one space after each word, nothing else between words
    kept = ~SPACE[buf]
    kept[ends[ends < len(buf)]] = True
    at = np.concatenate([[0], np.cumsum(kept)])
    flat = buf[kept]
    flat[SPACE[flat]] = 0x20
    begin, end = at[starts], at[starts] + (ends - starts)
    n = np.diff(first)
    shingles = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    where = np.concatenate([[0], np.cumsum(shingles)])
    head = np.arange(where[-1]) - np.repeat(where[:-1], shingles) + np.repeat(first[:-1], shingles)
    tail = np.minimum(head + shingle, np.repeat(first[1:], shingles)) - 1
    # words of two documents may stand without a space between: their shingles don't reach over
    view = memoryview(flat.tobytes())
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(shingles)
    if not len(full):
        return out
    step = 1 << 17
    ones = np.zeros((len(n), 64), np.int64)
    owner = np.repeat(np.arange(len(n)), shingles)
    for lo in range(0, int(where[-1]), step):
        hi = min(lo + step, int(where[-1]))
        h = np.fromiter((xxh64_intdigest(view[a:b], seed) for a, b in zip(begin[head[lo:hi]].tolist(), end[tail[lo:hi]].tolist(), strict=True)), np.uint64, hi - lo)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = owner[lo:hi]
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    set_bits = 2 * ones > shingles[:, None]
    return np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                fp = fingerprints_of(*utf8(batch.column(1)), shingle=shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _half_keys(fps: DataFrame) -> DataFrame:
    """Keys of both halves, with each bit a wildcard (equal halves meet in all)."""
    k = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    pos, side = F.col("k") % 32, F.floor(F.col("k") / 32).cast("long")
    half = F.when(side == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    mask = F.expr("~shiftleft(1L, k % 32)")
    return k.select((F.shiftleft(side, 38) + F.shiftleft(pos.cast("long"), 32) + half.bitwiseAND(mask)).alias("key"), F.lit(0).alias("sub"), "fp")


def _quarter_keys(rows: DataFrame) -> DataFrame:
    """For members of large keys: quarters of the half that the key leaves open."""
    k = rows.select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(33))).alias("k"))
    other = F.when(F.shiftright("key", 38) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    quarter = F.when(F.col("k") < 17, other.bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftright(other, 16)).cast("long")
    mask = F.when(F.col("k") % 17 < 16, F.expr("~shiftleft(1L, k % 17)")).otherwise(F.lit(-1).cast("long"))
    return k.select("key", (F.col("k") * 65536 + quarter.bitwiseAND(mask)).cast("int").alias("sub"), "fp")


def forest(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the components of links among distinct fingerprints."""
    n = len(fps)
    label = np.arange(n)
    while True:
        before = label.copy()
        step = max(1, (1 << 22) // n)  # 2**22 pairs at a time
        for lo in range(0, n, step):
            linked = np.bitwise_count(fps[lo : lo + step, None] ^ fps[None, :]) <= bits
            label[lo : lo + step] = np.where(linked, label[None, :], n).min(axis=1)
        label = label[label]
        if np.array_equal(label, before):
            break
    away = np.flatnonzero(label != np.arange(n))
    return fps[away], fps[label[away]]


def _verified(limit: int | None, bits: int):
    """mapInArrow over rows sorted by (key, sub, fp): edges of each key's
    members; members of a key with over ``limit`` of them go on as they are."""

    def rows(kind, key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(key, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "key", "a", "b"])

    def edges(keys, subs, fps):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(keys)))
        two = start[size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits
        a, b = [fps[two + 1][near]], [fps[two][near]]
        for s, n in zip(start[size > 2], size[size > 2], strict=True):
            x, y = forest(fps[s : s + n], bits)
            a.append(x)
            b.append(y)
        return np.concatenate(a), np.concatenate(b)

    def run(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)]
        passed = None  # the key that is too large, while its members pass
        for batch in batches:
            new = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)).view(np.uint64)]
            keys, subs, fps = (np.concatenate(x) for x in zip(held, new, strict=True))
            if passed is not None:
                n = int(np.searchsorted(keys, passed, "right"))
                if n:
                    yield rows(1, keys[:n], fps[:n], fps[:n])
                keys, subs, fps = keys[n:], subs[n:], fps[n:]
                if not len(keys):
                    held = [keys, subs, fps]
                    continue
                passed = None
            if not len(keys):
                continue
            last = int(np.flatnonzero((keys == keys[-1]) & (subs == subs[-1]))[0])
            yield from done(keys[:last], subs[:last], fps[:last])
            held = [keys[last:], subs[last:], fps[last:]]
            if limit and len(held[0]) > limit:
                yield rows(1, held[0], held[2], held[2])
                passed = int(held[0][0])
                held = [x[:0] for x in held]
        yield from done(*held)

    def done(keys, subs, fps):
        if not len(keys):
            return
        if limit:
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(start, len(keys)))
            large = np.repeat(size > limit, size)
            if large.any():
                yield rows(1, keys[large], fps[large], fps[large])
                keys, subs, fps = keys[~large], subs[~large], fps[~large]
        if len(keys):
            a, b = edges(keys, subs, fps)
            if len(a):
                yield rows(0, np.zeros(len(a), np.int64), a, b)

    return run


def links(fps: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(a, b): a forest with the same components as the links at ``bits`` (3 at
    most) or fewer differing bits among the distinct fingerprints ``fp``."""
    if bits > 3:
        raise ValueError("two halves hold one differing bit at most only up to 3 bits in all")
    schema = "kind int, key long, a long, b long"

    def meet(keys: DataFrame, limit: int | None) -> DataFrame:
        dealt = keys.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
        return dealt.mapInArrow(_verified(limit, bits), schema)

    found = written(meet(_half_keys(fps), group), "links")
    large = found.where("kind = 1").select("key", F.col("a").alias("fp"))
    return found.where("kind = 0").select("a", "b").unionByName(meet(_quarter_keys(large), None).select("a", "b"))


def _named(fps: DataFrame, bits: int) -> DataFrame:
    """fp, least (its least doc_id) and root (the fingerprint that stands for
    its component) of the distinct fingerprints."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = components(links(distinct.select("fp"), bits))
    return distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = _named(fps, bits)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
