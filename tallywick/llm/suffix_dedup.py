"""Operator 1: exact-substring dedup in corpus order by prefix-free parsing.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else
in the corpus.  Each document is one text; matches never cross documents.

*Parse.*  Rolling-hash triggers cut every text into phrases.  A starting
position belongs to the first trigger in reach after it, so what precedes the
trigger is a suffix of a phrase of the dictionary, and what follows it is a
suffix of the parse.  Triggers depend on the bytes of the string alone, so equal
strings have equal phrase suffixes and equal parse suffixes.  (Where no trigger
of the first rate is in reach one of a denser rate is taken, and where there is
none either the position is its own trigger; all three are decided by the
string's own bytes.)

*Prune.*  The ``CONTEXT`` bytes from a trigger on lie in every string of the
phrase.  Contexts of one occurrence in the corpus can't be in a repeat: hashes
are counted in blocks first, then across blocks, and only phrases with a
repeated context go on.  That is what makes highly repetitive text cheap: equal
phrases of a block travel once, with their number.

*Order.*  Phrases meet by context hash.  There the parse suffixes are sorted
(with the common prefix of neighbours) and phrase suffixes are refined a byte
at a time, from the trigger to the left.  (class of the phrase suffix, class of
the parse suffix at the remaining depth) is the corpus order of the strings at
depth ``LENGTH``: two strings are equal if both classes are.  No hash decides a
match.

*Cut.*  Each phrase's matched range goes back to the blocks that sent it, under
128 bits of hash that name the phrase within its block; the block cuts its texts
into phrases again, and the ranges of a text are merged.

The text goes through one shuffle, by block; all later steps use that exchange
again.  Wholly equal rows of a batch travel as one with their number, so a group
of equal rows (copies without id, say) doesn't fill its block.  A passage that
stands in every block sends its phrases to their buckets once a block, however
many texts of the block hold it; its buckets grow with the number of blocks.

Null texts are empty; texts shorter than ``LENGTH`` lose nothing; rows with the
same id (or wholly repeated rows) are texts of their own; an empty table gives
no rows; further columns are ignored unless carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import mix, slices, span_hashes, utf8, window_hashes
from .shared import block_count, collapsed, expanded

LENGTH, CONTEXT = 200, 64
#: Bytes of a rolling-hash window; rates of the two kinds of triggers, as powers of two.
WINDOW, SPARSE, DENSE = 16, 6, 4
#: Bytes of text in a block on average.
BLOCK_BYTES = 8 << 20


class Phrases:
    """The phrases of a buffer of texts: trigger, first and last starting
    position (in the buffer), text and context hash of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, context: int = CONTEXT):
        reach = length - context
        h = window_hashes(buf, WINDOW)
        ends = offsets[1:]
        m = h * np.uint64(0x9FB21C651E98DF25)
        sparse = np.flatnonzero(m >> np.uint64(64 - SPARSE) == 0)
        dense = np.flatnonzero((m >> np.uint64(64 - SPARSE - DENSE)) & np.uint64((1 << DENSE) - 1) == 1)

        def inside(t):
            text = np.searchsorted(offsets, t, "right") - 1
            ok = t + context <= ends[text] if len(t) else np.zeros(0, bool)
            return t[ok], text[ok]

        # texts of one byte or none share offsets with others; searchsorted takes the last, which holds the byte
        t, text = inside(sparse)
        dense, _ = inside(dense)
        first = np.ones(len(t), bool)
        first[1:] = text[1:] != text[:-1]
        previous = np.where(first, offsets[text] - 1, np.concatenate([[-1], t[:-1]])) if len(t) else t
        start = np.maximum(previous + 1, t - reach)
        stop = np.minimum(t, ends[text] - length)
        # positions without a sparse trigger in reach
        lo = previous + 1
        hi = np.minimum(start - 1, ends[text] - length)
        long_texts = np.flatnonzero(ends - offsets[:-1] >= length)
        after = np.full(len(ends), -1, np.int64)
        after[text] = t  # the last trigger of each text
        lo = np.concatenate([lo, np.where(after[long_texts] >= 0, after[long_texts] + 1, offsets[long_texts])])
        hi = np.concatenate([hi, ends[long_texts] - length])
        n = np.maximum(hi - lo + 1, 0)
        lo, n = lo[n > 0], n[n > 0]
        alone = np.sort(np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())) if len(lo) else np.zeros(0, np.int64)
        at = np.searchsorted(dense, alone)
        near = np.append(dense, np.iinfo(np.int64).max // 2)[at]
        own = np.where(near <= alone + reach, near, alone)
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        ok = stop >= start
        self.trigger = np.concatenate([t[ok], own[head]])
        self.start = np.concatenate([start[ok], alone[head]])
        self.stop = np.concatenate([stop[ok], alone[np.append(head[1:], len(own)) - 1] if len(head) else head])
        self.text = np.searchsorted(offsets, self.trigger, "right") - 1
        key = np.zeros(len(self.trigger), np.uint64)
        for k in range(0, context, WINDOW):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + h[self.trigger + k]
        self.key = key ^ (key >> np.uint64(32))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(11)) % np.uint64(buckets)).astype(np.int32)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_values)))


def matched(content: np.ndarray, base: np.ndarray, size: np.ndarray, left: np.ndarray, weight: np.ndarray, length: int = LENGTH, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """For phrases given by content[base : base + size], with the trigger
    ``left`` bytes in: the least and greatest number of bytes before the trigger
    at which a string starts that occurs more than once (-1: none)."""
    n = len(base)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not n:
        return low, high
    right = size - left
    least = length - right  # strings that start nearer to the trigger would pass the end of the text
    padded = np.concatenate([content, np.zeros(length, np.uint8)])
    suffix = np.lib.stride_tricks.sliding_window_view(padded, length)[base + left]
    for i in np.flatnonzero(right < length):
        suffix[i, right[i] :] = 0
    order = np.argsort(np.ascontiguousarray(suffix).view(f"S{length}").ravel(), kind="stable")
    suffix = suffix[order]
    differs = suffix[1:] != suffix[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    del suffix, differs
    left, weight, least, begin = left[order], weight[order], least[order], base[order]

    def parse_class(depth: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(common < depth)])

    live = np.arange(n)
    phrase = parse_class(context)
    for back in range(length - context + 1):
        if back:
            far = left[live] >= back
            live, phrase = live[far], phrase[far]
            phrase = phrase * 256 + content[begin[live] + left[live] - back]
        names, phrase = np.unique(phrase, return_inverse=True)
        many = np.bincount(phrase, weight[live], len(names)) >= 2
        kept = many[phrase]
        live, phrase = live[kept], phrase[kept]
        if not len(live):
            break
        starts_here = least[live] <= back
        here = live[starts_here]
        pair = phrase[starts_here].astype(np.int64) * (n + 1) + parse_class(length - back)[here]
        names, pair = np.unique(pair, return_inverse=True)
        hit = here[(np.bincount(pair, weight[here], len(names)) >= 2)[pair]]
        low[order[hit]] = np.where(low[order[hit]] < 0, back, low[order[hit]])
        high[order[hit]] = back
    return low, high


def _contexts(length: int, context: int, buckets: int):
    """Per block: the distinct context hashes, by bucket, and which of them
    occur in it more than once."""

    def run(table: pa.Table) -> pa.Table:
        keys, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in table.to_batches():
            for part in slices(batch, "text"):
                p = Phrases(*utf8(part.column("text")), length, context)
                keys.append(p.key)
                n.append(np.asarray(part.column("_copies"))[p.text])
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(n), len(keys))
        bucket = _bucket(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, n, bucket = keys[order], n[order], bucket[order]
        start, size = _runs(bucket)
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(bucket[start], pa.int32()),
                "block": pa.array(np.full(len(start), block), pa.int32()),
                "once": pa.array([(k := keys[s : s + z])[n[s : s + z] == 1].tobytes() for s, z in zip(start, size, strict=True)], pa.binary()),
                "more": pa.array([keys[s : s + z][n[s : s + z] > 1].tobytes() for s, z in zip(start, size, strict=True)], pa.binary()),
            }
        )

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Per bucket: for each block its context hashes that occur again, in the
    block or in another."""
    block = np.asarray(table.column("block"))
    once = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("once")]
    more = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("more")]
    keys, n = np.unique(np.concatenate([*once, *more, *more]), return_counts=True)
    twice = keys[n > 1]
    out = []
    for a, b in zip(once, more, strict=True):
        at = np.minimum(np.searchsorted(twice, a), max(len(twice) - 1, 0))
        out.append(np.concatenate([a[twice[at] == a] if len(twice) else a[:0], b]).tobytes())
    kept = [k for k, x in enumerate(out) if x]
    return pa.table({"block": pa.array(block[kept], pa.int32()), "keys": pa.array([out[k] for k in kept], pa.binary())})


#: What a block knows a phrase by: 128 bits of hash of its bytes and its trigger's place.
NAME = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _names(p: Phrases, buf: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(p.key), NAME)
    out["a"] = mix(span_hashes(buf, p.start, p.stop + length) + (p.trigger - p.start).astype(np.uint64))
    out["b"] = p.key
    return out


def _phrases(length: int, context: int, buckets: int):
    """Per block: its distinct phrases with a repeated context, by bucket."""

    def run(texts: pa.Table, repeated: pa.Table) -> pa.Table:
        kinds = ["content", "names", "size", "left", "weight"]
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in kinds]])
        if not len(texts) or not len(repeated):
            return schema.empty_table()
        wanted = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in repeated.column("keys")]))
        names, found, copies, whole, base = [], [], [], [], 0
        for batch in texts.to_batches():
            for part in slices(batch, "text"):
                buf, offsets = utf8(part.column("text"))
                p = Phrases(buf, offsets, length, context)
                at = np.minimum(np.searchsorted(wanted, p.key), len(wanted) - 1)
                kept = np.flatnonzero(wanted[at] == p.key)
                names.append(_names(p, buf, length)[kept])
                found.append(np.stack([p.start[kept] + base, p.stop[kept] + length - p.start[kept], p.trigger[kept] - p.start[kept]]))
                copies.append(np.asarray(part.column("_copies"))[p.text[kept]])
                whole.append(buf)
                base += len(buf)
        names, first, at = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        begin, size, left = np.concatenate(found, axis=1)[:, first]
        weight = np.bincount(at, np.concatenate(copies), len(names)).astype(np.int64)
        whole = memoryview(np.concatenate(whole).tobytes())
        bucket = _bucket(names["b"], buckets)
        order = np.argsort(bucket, kind="stable")
        rows = {c: [] for c in schema.names}
        for s, z in zip(*_runs(bucket[order]), strict=True):
            own = order[s : s + z]
            rows["bucket"].append(int(bucket[own[0]]))
            rows["content"].append(b"".join([whole[b : b + n] for b, n in zip(begin[own].tolist(), size[own].tolist(), strict=True)]))
            for c, values, kind in (("names", names, NAME), ("size", size, np.int32), ("left", left, np.int32), ("weight", weight, np.int32)):
                # a phrase that occurs twice is as good as one that occurs more often
                rows[c].append((np.minimum(values[own], 2) if c == "weight" else values[own]).astype(kind).tobytes())
        rows["block"] = [texts.column("block")[0].as_py()] * len(rows["bucket"])
        return pa.table(rows, schema)

    return run


#: A phrase whose strings from ``low`` to ``high`` bytes before its trigger occur again.
RANGE = np.dtype([*NAME.descr, ("low", np.int16), ("high", np.int16)])


def _match(length: int, context: int):
    """Per bucket: which strings of its phrases occur again, by block."""

    def run(table: pa.Table) -> pa.Table:
        gather = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)])
        content, size, left, weight = gather("content", np.uint8), gather("size", np.int32).astype(np.int64), gather("left", np.int32).astype(np.int64), gather("weight", np.int32)
        low, high = matched(content, np.cumsum(size) - size, size, left, weight, length, context)
        blocks, ranges, at = [], [], 0
        for block, names in zip(table.column("block"), table.column("names"), strict=True):
            names = np.frombuffer(names.as_py(), NAME)
            own = np.zeros(len(names), RANGE)
            own["a"], own["b"], own["low"], own["high"] = names["a"], names["b"], low[at : at + len(names)], high[at : at + len(names)]
            at += len(names)
            own = own[own["high"] >= 0]
            if len(own):
                blocks.append(block.as_py())
                ranges.append(own.tobytes())
        return pa.table({"block": pa.array(blocks, pa.int32()), "ranges": pa.array(ranges, pa.binary())})

    return run


def _spans(p: Phrases, names: np.ndarray, ranges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end in the buffer) of what goes, sorted by text and begin."""
    if not len(ranges) or not len(names):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.minimum(np.searchsorted(ranges["a"], names["a"]), len(ranges) - 1)
    hit = np.flatnonzero((ranges["a"][at] == names["a"]) & (ranges["b"][at] == names["b"]))
    at = at[hit]
    text, begin, end = p.text[hit], p.trigger[hit] - ranges["high"][at], p.trigger[hit] - ranges["low"][at] + length
    order = np.lexsort((begin, text))
    return text[order], begin[order], end[order]


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they hold only a part of."""
    inner = lambda i: 0 < i < len(text) and text[i] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while inner(a):
            a += 1
        while inner(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _cut(carry: list[str], keep_text: bool, added: list[tuple[str, pa.DataType]], length: int, context: int):
    """Per block: what is left of its texts."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        ranges = np.concatenate([np.zeros(0, RANGE), *[np.frombuffer(x.as_py(), RANGE) for x in found.column("ranges")]])
        ranges = ranges[np.argsort(ranges["a"], kind="stable")]
        columns: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")}
        texts = texts.combine_chunks()
        for batch in texts.to_batches():
            for part in slices(batch, "text"):
                buf, offsets = utf8(part.column("text"))
                raw = memoryview(buf.tobytes())
                p = Phrases(buf, offsets, length, context)
                owner, begin, end = _spans(p, _names(p, buf, length), ranges, length)
                begin, end = begin - offsets[owner], end - offsets[owner]
                lo = np.searchsorted(owner, np.arange(len(offsets)))
                for k in range(len(offsets) - 1):
                    text = raw[offsets[k] : offsets[k + 1]]
                    spans: list[tuple[int, int]] = []
                    for a, b in zip(begin[lo[k] : lo[k + 1]].tolist(), end[lo[k] : lo[k + 1]].tolist(), strict=True):
                        if spans and a <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                        else:
                            spans.append((a, b))
                    digest, at = hashlib.sha256(), 0
                    for a, b in spans:
                        digest.update(text[at:a])
                        at = b
                    digest.update(text[at:])
                    columns["n_bytes"].append(len(text))
                    columns["n_removed"].append(sum(b - a for a, b in spans))
                    columns["n_spans"].append(len(spans))
                    columns["kept_sha256"].append(digest.hexdigest())
                    if keep_text:
                        whole = bytes(text)
                        out, at = [], 0
                        for a, b in _whole_characters(whole, spans):
                            out.append(whole[at:a])
                            at = b
                        columns["kept_text"].append((b"".join(out) + whole[at:]).decode("utf-8", "replace"))
                        columns["spans"].append([{"from": a, "to": b} for a, b in spans])
        return pa.table({c: texts.column(c) for c in carry} | {c: pa.array(columns[c], kind) for c, kind in added})

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the carried columns, n_bytes,
    n_removed, n_spans, kept_sha256 and, with ``keep_text``, spans (removed byte
    ranges) and kept_text (without the characters that lie wholly in them)."""
    spark = docs.sparkSession
    context = min(CONTEXT, length // 4 // WINDOW * WINDOW)
    if context < WINDOW or length - context > 255:
        raise ValueError("length must be from 64 to 319 bytes")
    carry = [c for c in (carry or []) if c not in (id_col, text_col)]
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks = block_count(spark, total, BLOCK_BYTES)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *carry)
    rows = collapsed(rows).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    contexts = rows.groupBy("block").applyInArrow(_contexts(length, context, blocks), "bucket int, block int, once binary, more binary")
    repeated = contexts.groupBy("bucket").applyInArrow(_repeated, "block int, keys binary")
    phrases = (
        rows.groupBy("block")
        .cogroup(repeated.groupBy("block"))
        .applyInArrow(_phrases(length, context, blocks), "bucket int, block int, content binary, names binary, size binary, left binary, weight binary")
    )
    found = phrases.groupBy("bucket").applyInArrow(_match(length, context), "block int, ranges binary")
    last = [("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string())]
    if keep_text:
        last += [("spans", "array<struct<from: long, to: long>>", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept_text", "string", pa.string())]
    fields = [f for f in rows.schema.fields if f.name in ("doc_id", *carry, "_copies")]
    out = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in last]])
    left = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut([f.name for f in fields], keep_text, [(n, t) for n, _, t in last], length, context), out)
    return expanded(left)
