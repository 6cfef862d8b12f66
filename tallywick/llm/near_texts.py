"""Near-duplicate rows: operator 8's signatures for a similarity of sets.

Two texts are near copies if the Jaccard similarity of their sets of
``SHINGLE``-word shingles is at least ``SIMILARITY``.  Fingerprints of 64 bits
and few differing bits can't reach that, so a SimHash here has a code of 64 bits
and, apart from it, ``segments`` of ``SEGMENT_BITS`` bits.  Segments are few
enough that one of them differs by at most one bit with probability ``RECALL`` at
the least similarity (more surely above it): each segment is indexed with each
bit a wildcard, equal keys meet in a shuffle, pairs whose codes are close become
candidates, and the exact similarity of their sets decides.  SimHash bits say
little of sets of a few shingles; these also meet where one is the other less a
shingle, by hashes of the set and of the set less each shingle.

Texts of one code are one node of the index if their sets are near that of the
code's first text; sets that aren't get codes of their own, a few bits away.  A key's nodes come sorted from
the shuffle and leave as a least spanning forest by differing bits, not as all
pairs (but where there are four at most).  A key of over ``GROUP`` nodes passes in pieces, each with the key's first
``PIVOTS`` nodes.  Once the forests' pairs are verified, every close pair of a key
that a forest or a piece left out and whose nodes aren't of one class yet is
verified too (``left_out``), so that no near pair which shares a key is lost.  In a
large group of looser copies most such pairs are of sets that aren't near: pairs
whose parity bits (``parities``) rule that out aren't made.

A null text is an empty one, and texts without a word are copies of each other; a
text of fewer words than a shingle has one shingle of all its words.  Rows are
told apart by 128 bits of hash over all their columns, not by their id.  A text of
any length is taken whole, in a batch of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import lower, mix, slices, span_hashes, utf8, words
from .shared import written

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9
SEGMENT_BITS, GROUP, PIVOTS = 20, 1024, 16
#: Rows without likeness that may share a key on average, before segments grow.
STRANGERS = 64
#: Standard deviations of a code's differing bits that candidates may lie above the mean.
SPREAD = 2.5
#: Columns of 64 parity bits each.
PARITY = [f"parity_{i}" for i in range(16)]


def bit_share(similarity: float) -> float:
    """The share of bits in which SimHashes of sets of that similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def segments_needed(bits: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    p = bit_share(similarity)
    near = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - near))


def code_limit(similarity: float = SIMILARITY) -> int:
    p = bit_share(similarity)
    return math.floor(64 * p + SPREAD * math.sqrt(64 * p * (1 - p)))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles, in order; first of each text and the total)."""
    buf = lower(buf)
    starts, ends, first = words(buf, offsets)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    where = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    head = np.arange(where[-1]) - np.repeat(where[:-1], count) + np.repeat(first[:-1], count)
    size = np.minimum(shingle, n[owner])
    h = span_hashes(buf, starts, ends)
    key = size.astype(np.uint64)
    for j in range(shingle):
        # a text's only shingle may be shorter
        word = h[np.minimum(head + j, max(len(h) - 1, 0))] if len(h) else h
        key = np.where(j < size, mix(key * np.uint64(0xD6E8FEB86659FD93) + word), key)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[: len(key)]
    return key[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def set_hashes(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hash of each text's set, the same for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys), dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def without_one(keys: np.ndarray, first: np.ndarray, similarity: float = SIMILARITY) -> list[bytes]:
    """For sets so small that SimHash bits say little: the hashes of the set less
    each one of its shingles, which is the hash of a near set that lacks it."""
    least = similarity / max(1 - similarity, 1e-9)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys), dtype=np.uint64)])
    n = np.diff(first)
    out = [b""] * len(n)
    for k in np.flatnonzero((n - 1 >= least - 1e-9) & (n <= 2 * least + 1 + 1e-9)):
        own = mix(keys[first[k] : first[k + 1]])
        out[k] = mix(total[first[k + 1]] - total[first[k]] - own + np.uint64(n[k] - 1)).tobytes()
    return out


def small_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): codes of ``sets`` (code, of_set, parts) of which one is the other
    less a shingle."""

    def run(batches):
        for batch in batches:
            parts = batch.column(1).to_pylist()
            n = [len(x) // 8 for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(parts), np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), n))], ["of_set", "more"])

    parts = sets.where("length(parts) > 0").select("code", "parts").mapInArrow(run, "of_set long, more long")
    return sets.select("code", "of_set").join(parts, "of_set").where("code <> more").select(F.least("code", "more").alias("a"), F.greatest("code", "more").alias("b"))


def sketches(keys: np.ndarray, first: np.ndarray, lanes: int, similarity: float = SIMILARITY) -> np.ndarray:
    """(texts, lanes) SimHash bits, 64 a lane.  Of an even number of shingles the
    one of greatest hash doesn't vote, so that there is no tie.  That gives one code
    to sets that differ in two shingles; where such sets are too small to be near,
    all vote and ties go by the set's hash.  Sets so small that only equal ones are
    near have the hash itself."""
    n = np.diff(first)
    out = np.zeros((len(n), lanes), np.uint64)
    some = np.flatnonzero(n)
    least = similarity / max(1 - similarity, 1e-9)  # a set of n and one more are near from here on
    equal_only = (n > 0) & (n < least - 1e-9)
    tied = (n % 2 == 0) & (n < 2 * least + 1 - 1e-9)
    of_set = set_hashes(keys, first)
    vote = np.ones(len(keys), bool)
    vote[first[1:][some[(n[some] % 2 == 0) & ~tied[some]]] - 1] = False
    keys, owner = keys[vote], np.repeat(np.arange(len(n)), n)[vote]
    if not len(keys):
        return out
    most = np.maximum(n - ((n % 2 == 0) & ~tied), 0)[:, None]
    step = 1 << 15
    for lane in range(lanes):
        ones = np.zeros((len(n), 64), np.int64)
        for lo in range(0, len(keys), step):
            h = mix(keys[lo : lo + step] + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            own = owner[lo : lo + step]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ones[own[cut]] += np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), cut, axis=0, dtype=np.int64)
        bits = 2 * ones > most
        own_bits = mix(of_set + np.uint64((lane + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
        draw = np.flatnonzero(tied & (n > 0))
        bits[draw] |= (2 * ones[draw] == most[draw]) & np.unpackbits(own_bits[draw].view(np.uint8).reshape(-1, 8), axis=1).astype(bool)
        out[:, lane] = np.packbits(bits, axis=1).view(np.uint64).ravel()
        out[equal_only, lane] = own_bits[equal_only]
    return out


def parities(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, columns of ``PARITY``): bit i says whether the number of the set's
    hashes that are i modulo the number of bits is odd.  Each bit in which two sets
    differ there takes one shingle at least that only one of them has."""
    bits = 64 * len(PARITY)
    out = np.empty((len(first) - 1, len(PARITY)), np.uint64)
    for lo in range(0, len(out), 256):
        own = first[lo : lo + 257]
        at = np.repeat(np.arange(len(own) - 1) * bits, np.diff(own)) + (keys[own[0] : own[-1]] % np.uint64(bits)).astype(np.int64)
        odd = (np.bincount(at, minlength=(len(own) - 1) * bits) & 1).astype(np.uint8)
        out[lo : lo + 256] = np.packbits(odd.reshape(-1, bits), axis=1).view(np.uint64)
    return out


def may_be_near(similarity: float) -> Column:
    """Over ``size`` and ``PARITY`` of two sets, a's and b's: false only where their
    similarity is less, since sets of that similarity differ in so many shingles at most."""
    odd = [F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITY]
    return sum(odd[1:], odd[0]) <= (F.col("a_size") + F.col("b_size")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)


def flipped(code: np.ndarray, of_set: np.ndarray) -> np.ndarray:
    """The codes with up to three bits changed, which the set's hash names."""
    for k in range(3):
        code = code ^ (np.uint64(1) << (mix(of_set + np.uint64(k)) & np.uint64(63)))
    return code


def segment_keys(sketch: np.ndarray, segments: int, bits: int) -> np.ndarray:
    """(texts, segments * bits) keys: each segment with each of its bits a wildcard."""
    flags = np.unpackbits(sketch.view(np.uint8).reshape(len(sketch), -1), axis=1)[:, : segments * bits].reshape(len(sketch), segments, bits)
    value = flags.astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    open_bit = ~(np.int64(1) << np.arange(bits, dtype=np.int64))
    name = (np.arange(segments, dtype=np.int64)[:, None] << 54) + (np.arange(bits, dtype=np.int64)[None, :] << 48)
    return ((value[:, :, None] & open_bit) + name).reshape(len(sketch), -1)


def least_forest(codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (as places in ``codes``) of the forest of least differing bits among
    pairs that differ in ``limit`` bits at most."""
    n = len(codes)
    best, parent = np.full(n, 255, np.uint8), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    a, b, j = [], [], 0
    for _ in range(n):
        left[j] = False
        d = np.bitwise_count(codes ^ codes[j])
        nearer = left & (d < best)
        best[nearer], parent[nearer] = d[nearer], j
        best[j] = 255
        j = int(best.argmin())
        if best[j] == 255:  # one at 255 is left at most where none is
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            j = int(rest[0])
        elif best[j] <= limit:
            a.append(j)
            b.append(int(parent[j]))
    return np.array(a, np.int64), np.array(b, np.int64)


def near_codes(codes: np.ndarray, start: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs among the groups of ``codes`` that begin at ``start``, and
    the groups that may have more close pairs than these."""
    size = np.diff(np.append(start, len(codes)))
    group = np.repeat(np.arange(len(start)), size)
    # nearly all groups hold strangers: which have a close pair is seen for all small groups at once
    close = np.zeros(len(start), np.int64)
    pair_a, pair_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = size <= 16
    for d in range(1, int(min(16, size.max(initial=1)))):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[group[d:]])
        i = i[np.bitwise_count(codes[i] ^ codes[i + d]) <= limit]
        np.add.at(close, group[i], 1)
        pair_a.append(i)
        pair_b.append(i + d)
    i, j = np.concatenate(pair_a), np.concatenate(pair_b)
    alone = (close[group[i]] == 1) | (size[group[i]] <= 4)
    out_a, out_b, more = [codes[i[alone]]], [codes[j[alone]]], []
    for g in np.flatnonzero(((close > 1) & (size > 4)) | ~small):
        own = codes[start[g] : start[g] + size[g]]
        x, y = least_forest(own, limit)
        out_a.append(own[x])
        out_b.append(own[y])
        # a forest of one edge leaves no other pair
        if len(x) > 1 and not (small[g] and len(x) == close[g]):
            more.append(g)
    return np.concatenate(out_a), np.concatenate(out_b), np.array(more, np.int64)


def _meet(limit: int, group: int, pivots: int):
    """mapInArrow over rows sorted by (key, code): candidate pairs (a, b) of each
    key, and (a, null, key) for the codes of keys that may have more close pairs."""

    def run(batches):
        keys, codes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = None  # the first nodes of a key that passes in pieces

        def members(keys, codes):
            if len(keys):
                none = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), none, pa.array(keys)], ["a", "b", "key"])

        def pairs(keys, codes, in_pieces=False):
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            a, b, more = near_codes(codes, start, limit)
            if len(more) and not in_pieces:
                of = np.isin(np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys)))), more)
                yield from members(keys[of], codes[of])
            flip = a > b
            a, b = np.where(flip, b, a), np.where(flip, a, b)
            if len(a):
                both = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), pa.nulls(both.shape[1], pa.int64())], ["a", "b", "key"])

        def piece(codes):
            whole = np.concatenate([first[1], codes])
            yield from members(np.full(len(codes), first[0], np.int64), codes)
            yield from pairs(np.zeros(len(whole), np.int64), whole, True)

        for batch in batches:
            keys = np.concatenate([keys, np.asarray(batch.column(0))])
            codes = np.concatenate([codes, np.asarray(batch.column(1)).view(np.uint64)])
            while len(keys):
                if first is not None and keys[0] != first[0]:
                    first = None
                end = int(np.searchsorted(keys, keys[0], "right"))
                if first is not None:
                    if end == len(keys) and end < group:
                        break
                    yield from piece(codes[: min(end, group)])
                    keys, codes = keys[min(end, group) :], codes[min(end, group) :]
                    continue
                if end > group:
                    first = (keys[0], codes[:pivots])
                    yield from members(keys[:pivots], codes[:pivots])
                    keys, codes = keys[pivots:], codes[pivots:]
                    continue
                if end == len(keys):
                    break
                # whole keys up to the last or the next large one
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                large = np.flatnonzero(np.diff(np.append(starts, len(keys))) > group)
                to = int(starts[large[0]] if len(large) else starts[-1])
                yield from pairs(keys[:to], codes[:to])
                keys, codes = keys[to:], codes[to:]
        if len(keys):
            if first is not None and keys[0] == first[0]:
                yield from piece(codes)
            else:
                yield from pairs(keys, codes)

    return run


def candidates(nodes: DataFrame, segments: int, bits: int, limit: int, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, null): pairs of codes of ``nodes`` (code, sketch) that share a key and
    are close; (a, null, key): codes of keys that may have more of them."""

    def index(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(batch), -1)
                keys = segment_keys(sketch, segments, bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), keys.shape[1]))], ["key", "code"])

    keys = nodes.select("code", "sketch").mapInArrow(index, "key long, code long")
    return keys.repartition("key").sortWithinPartitions("key", "code").mapInArrow(_meet(limit, group, pivots), "a long, b long, key long")


def left_out(members: DataFrame, roots: DataFrame, limit: int, group: int = GROUP, bounds: DataFrame | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): the close pairs of ``members`` (key, code) that share a key and whose
    classes (``roots``: node, root) differ, without those of which ``bounds`` (code,
    size, ``PARITY``) tells that they aren't near.  A key's codes that aren't of its
    largest class meet all its codes, in squares of about ``group`` by ``group`` each."""
    told = ["size", *PARITY] if bounds is not None else []
    known = roots.select(F.col("node").alias("code"), "root")
    known = bounds.select("code", *told).join(known, "code", "left") if told else known
    named = members.join(known, "code", "left").withColumn("root", F.coalesce("root", "code"))
    # each member beside what its key holds: one shuffle, by key
    parts = lambda n: F.ceil(n / F.lit(group)).cast("long")
    counted = named.withColumns({"n": F.count("*").over(Window.partitionBy("key")), "own": F.count("*").over(Window.partitionBy("key", "root"))})
    counted = counted.withColumn("m", F.max(F.struct("own", "root")).over(Window.partitionBy("key"))).where("n > m.own")
    found = counted.select("key", "code", "root", *told, F.col("m.root").alias("top"), parts(F.col("n") - F.col("m.own")).alias("rows"), parts(F.col("n")).alias("columns"))
    found = written(found, "left-out")
    place = lambda n: F.pmod(F.xxhash64("code"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    side = lambda s: [F.col("code").alias(s), F.col("root").alias(f"of_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in told]]
    x = found.where("root <> top").select("key", *side("a"), place(F.col("rows")).alias("i"), each(F.col("columns")).alias("j"))
    y = found.select("key", *side("b"), place(F.col("columns")).alias("j"), each(F.col("rows")).alias("i"))
    met = x.join(y.hint("merge"), ["key", "i", "j"]).where((F.col("of_a") != F.col("of_b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit))
    met = met.where(may_be_near(similarity)) if told else met
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def near_rows(keyed: DataFrame, keys: tuple[str, str], similarity: float = SIMILARITY, shingle: int = SHINGLE, bits: int | None = None, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): the row keys, doc_id and code of every row of ``keyed`` (its
    columns ``keys`` tell rows apart), and (code, root) of the codes in a class
    of several, whose least code is its root."""
    total = keyed.count()
    bits = bits or max(SEGMENT_BITS, math.ceil(math.log2(max(total, 1) / STRANGERS)))
    segments = segments_needed(bits, similarity)
    lanes = 1 + -(-segments * bits // 64)
    told = ["size", *PARITY]

    def sketch(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = shingle_sets(*utf8(batch.column(3)), shingle)
                s = sketches(*found, lanes, similarity)
                longs = [pa.array(x.copy().view(np.int64)) for x in (s[:, 0], set_hashes(*found), np.diff(found[1]), *parities(*found).T)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *longs, pa.array([x.tobytes() for x in s[:, 1:]], pa.binary()), pa.array(without_one(*found, similarity), pa.binary())], [*keys, "doc_id", "code", "of_set", *told, "sketch", "parts"])

    def sets(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                h, first = shingle_sets(*utf8(batch.column(whole.num_columns - 1)), shingle)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], [*batch.schema.names[:-1], "shingles"])

    texts = keyed.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = written(texts.mapInArrow(sketch, f"{keys[0]} long, {keys[1]} long, doc_id long, code long, of_set long, {', '.join(f'{c} long' for c in told)}, sketch binary, parts binary"), "sketches")
    # one row stands for the texts of a set
    each = written(sketched.groupBy("code", "of_set").agg(F.min(F.struct(*keys, "sketch", "parts", *told)).alias("m")).select("code", "of_set", "m.*"), "sets")

    # of a code's sets those that aren't near its first get codes of their own
    mixed = each.groupBy("code").agg(F.count("*").alias("n"), F.min(F.struct(*keys)).alias("first")).where("n > 1").select("code", "first")
    asked = each.select("code", "of_set", *keys).join(mixed, "code")
    own = texts.join(asked, list(keys)).select("code", "of_set", (F.struct(*keys) == F.col("first")).alias("leads"), "text").dropDuplicates(["code", "of_set"])
    own = written(own.mapInArrow(sets, "code long, of_set long, leads boolean, shingles binary"), "mixed-codes")

    def apart(batches):
        for batch in batches:
            far = [_jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) < similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            batch = batch.select(["code", "of_set"]).filter(pa.array(far, pa.bool_()))
            new = flipped(*(np.asarray(c).view(np.uint64) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new.view(np.int64))], ["code", "of_set", "new"])

    leads = own.where("leads").select("code", F.col("shingles").alias("y"))
    moved = written(own.where("NOT leads").join(leads, "code").select("code", "of_set", "shingles", "y").mapInArrow(apart, "code long, of_set long, new long"), "codes-apart")
    recoded = lambda df: df.join(moved, ["code", "of_set"], "left").withColumn("code", F.coalesce("new", "code")).drop("new")
    nodes = written(recoded(each).groupBy("code").agg(F.min(F.struct(*keys, "of_set", "sketch", *told)).alias("m")).select("code", "m.*"), "nodes")
    limit = code_limit(similarity)
    met = written(candidates(nodes, segments, bits, limit, group), "met")

    def verify(batches):
        for batch in batches:
            good = [_jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verified(pairs):
        """The pairs of codes whose sets are near."""
        asked = pairs.select(F.col("a").alias("code")).unionByName(pairs.select(F.col("b").alias("code"))).distinct()
        stand = written(nodes.join(asked, "code").select("code", *keys), "asked")
        # merge joins at every size, so that a small table tells what a large one costs
        own = texts.join(stand.hint("merge"), list(keys)).select("code", "text").dropDuplicates(["code"])
        own = written(own.mapInArrow(sets, "code long, shingles binary"), "shingles")
        both = pairs.join(own.select(F.col("code").alias("a"), F.col("shingles").alias("x")), "a").join(own.select(F.col("code").alias("b"), F.col("shingles").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")

    pairs = met.where("key IS NULL").select("a", "b").unionByName(small_pairs(recoded(each)))
    roots = components(verified(written(pairs.distinct(), "candidates")))
    rest = written(left_out(met.where("key IS NOT NULL").select("key", F.col("a").alias("code")), roots, limit, group, nodes, similarity), "candidates-left-out")
    if not rest.isEmpty():
        roots = components(roots.unionByName(verified(rest).toDF("node", "root")))
    return recoded(sketched.drop("sketch", "parts", *told)).drop("of_set"), roots.select(F.col("node").alias("code"), "root")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bits: int | None = None, group: int = GROUP) -> DataFrame:
    """One row of each class of near copies: that of least id, a row without id
    only where none has one; of wholly equal rows one stays."""
    keys = ("row_a", "row_b")
    row = [F.struct(*docs.columns), *(F.col(c).isNull() for c in docs.columns)]
    keyed = docs.withColumns({"row_a": F.xxhash64(*row), "row_b": F.xxhash64(F.lit(1), *row)})
    rows, roots = near_rows(keyed, keys, similarity, shingle, bits, group)
    named = rows.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code"))
    # a class' wholly equal rows count as one row with their number
    named = named.groupBy("root", "doc_id", *keys).agg(F.count("*").alias("n"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", *keys)).alias("m"))
    named = named.join(first, "root").withColumn("stays", (F.col("m.row_a") == F.col("row_a")) & (F.col("m.row_b") == F.col("row_b")))
    out = written(named.where(~F.col("stays") | (F.col("n") > 1)).select(*keys, "stays"), "near-copies")
    # both joins read one shuffle of the rows
    kept = keyed.join(out.select(*keys).hint("merge"), list(keys), "left_anti")
    repeated = keyed.join(out.where("stays").select(*keys).hint("merge"), list(keys), "left_semi").dropDuplicates(list(keys))
    return kept.unionByName(repeated).select(*docs.columns)
