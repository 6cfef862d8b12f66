"""Operator 10: benchmark decontamination by CGK embedding and bit sampling.

Texts and items are compared as lower-cased bytes with white space runs as one
space.  Windows of a document that have an item's size stand where the short
strings (3 to 8 bytes) that it shares with the item vote for one start, with as
many votes as copies with the most edits allowed still give (``Votes``; no
string of any greater length has to survive whole).  They are embedded by the
CGK random walk (it maps edit distance to Hamming distance) next to the items;
several walks, each sampled at several sets of positions, give keys that meet in
an equality join with the items' keys of the same size.  The number of keys
follows from the target recall.  What meets is verified by exact edit distance
against the window with slack on both sides: the best substring counts.

Items are a stated query set: they go out in blocks of bounded size, against all
documents.  A document counts as contaminated by an item if some substring is
within ``1 - similarity`` of the item's length in edits.  Items shorter than
``SHORT_BYTES`` bytes must occur exactly, items that are null or empty never do.
Null and empty texts have no window.  Repeated documents each count; of repeated
item ids each text counts, and the best remains.  Empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SPACE, lower, mix, slices, utf8

SIMILARITY, RECALL = 0.8, 0.95
#: Items of fewer bytes must occur exactly.
SHORT_BYTES = 16
#: Random walks, positions in a key, and the share of positions at which pairs at the least similarity agree (measured in the tests).
WALKS, SAMPLE, AGREE = 8, 3, 0.3
#: Share of copies with the most edits allowed, at random places, that gather too few votes; draws that set it.
MISSED, DRAWS = 0.01, 200
#: Places of a gram in an item that vote; items beyond which a gram is common.
PLACES, ITEMS_OF_GRAM = 4, 64
#: Bytes of text that vote at a time, which bounds a task's arrays.
SLICE_BYTES = 1 << 19
#: Bytes of item text in a block, which bounds the broadcasts.
ITEM_BLOCK_BYTES = 4 << 20


def normal(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, white space runs as one space, none at the ends of a text."""
    buf = lower(buf)
    gap = SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    kept = ~gap
    kept[:-1] |= gap[:-1] & ~gap[1:] & ~edge[1:-1]  # the last of a run, unless the text ends there
    at = np.concatenate([[0], np.cumsum(kept)])
    out, start = buf[kept], at[offsets]
    lead = np.flatnonzero((np.diff(start) > 0) & (SPACE[np.append(out, 0)[start[:-1]]]))
    if len(lead):
        drop = np.ones(len(out), bool)
        drop[start[lead]] = False
        out = out[drop]
        start = np.concatenate([[0], np.cumsum(drop)])[start]
    out[SPACE[out]] = 0x20
    return out, start


def keys_needed(recall: float = RECALL, agree: float = AGREE, sample: int = SAMPLE) -> int:
    """Independent keys for which a pair that agrees at a share ``agree`` of
    positions shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sample))


def cgk_keys(buf: np.ndarray, start: np.ndarray, size: np.ndarray, fits: np.ndarray | None = None, recall: float = RECALL) -> np.ndarray:
    """(strings, keys) 64-bit keys of buf[start : start + size], of which only
    ``fits`` bytes are there.  Equal strings have equal keys, and only strings of
    one size can share keys."""
    fits = size if fits is None else fits
    walks = WALKS
    each = -(-keys_needed(recall) // walks)
    n = len(start)
    out = np.zeros((n, walks * each), np.uint64)
    if not n:
        return out
    sizes, number = np.unique(size, return_inverse=True)
    most = int(sizes[-1])
    padded = np.append(buf, np.uint8(0))
    for walk in range(walks):
        # keys sample the steps that a string of the size takes on average
        steps = max(SAMPLE, 2 * most)
        step = np.random.default_rng(walk).integers(0, 2, (3 * most, 256), dtype=np.uint8)
        at = np.zeros(n, np.int64)
        walked = np.zeros((steps, n), np.uint8)
        for j in range(steps):
            byte = np.where(at < fits, padded[np.minimum(start + at, len(buf))], 0)
            walked[j] = byte
            at += step[j][byte]
        for k in range(each):
            key = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(walk * 4096 + k))
            places = np.stack([np.random.default_rng((walk, k, int(s))).choice(max(SAMPLE, 2 * int(s)), SAMPLE, replace=False) for s in sizes])
            for p in range(SAMPLE):
                byte = walked[places[number, p], np.arange(n)]
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + byte.astype(np.uint64))
            out[:, walk * each + k] = key
    return out


def edit_distance_within(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(least edit distance of ``item`` to a substring of ``text``, end of the
    first such substring), by bit-parallel columns; None if over ``most``."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


def gram_bytes(size: int) -> int:
    """Bytes of the strings that vote for an item of ``size``: short enough that
    copies with the most edits keep some, long enough to be rare elsewhere."""
    return 3 if size < 24 else 4 if size < 48 else 6 if size < 120 else 8


def grams(buf: np.ndarray, width: int) -> np.ndarray:
    """The strings of ``width`` bytes (8 at most) as numbers."""
    if len(buf) < width:
        return np.zeros(0, np.uint64)
    n = len(buf) - width + 1
    powers = {1: buf.astype(np.uint64)}
    for w in (1, 2, 4):
        if 2 * w <= width:
            powers[2 * w] = powers[w][:-w] << np.uint64(8 * w) | powers[w][w:]
    h, at = None, 0
    for w in (8, 4, 2, 1):
        if width & w:
            own = powers[w][at : at + n]
            h = own if h is None else h << np.uint64(8 * w) | own
            at += w
    return h


def drift(size: int) -> int:
    """How far insertions and deletions may spread the starts that grams vote for."""
    return max(12, size // 8)


@lru_cache(4096)
def least_votes(size: int, width: int, similarity: float) -> int:
    """The votes within ``drift`` of each other that all but ``MISSED`` of the
    copies keep that have the most edits allowed, at random places and of random
    kinds (replaced, inserted, deleted)."""
    rng = np.random.default_rng(size)
    most, band, seen = int((1 - similarity) * size + 1e-9), drift(size), np.zeros(DRAWS, np.int64)
    for k in range(DRAWS):
        at = rng.choice(size, most, replace=False)
        edit, moved = np.zeros(size + 1, np.int64), np.zeros(size, np.int64)
        edit[1 + at] = 1
        moved[at] = rng.integers(-1, 2, most)
        shift = np.cumsum(moved)
        before = np.cumsum(edit)
        whole = np.flatnonzero(before[width:] == before[:-width])
        if len(whole):
            about = np.bincount(shift[whole] - shift[whole].min())
            seen[k] = np.convolve(about, np.ones(band, np.int64)).max()
    return max(2, int(np.sort(seen)[int(MISSED * DRAWS)]))


class Votes:
    """Where the grams of an item vote for one start in a text.

    Each gram that a text shares with an item votes for the start at which the
    item would have to stand; an edited copy gathers votes within ``drift`` of
    its start, other texts scatter theirs.  A gram's places in an item beyond
    ``PLACES`` don't vote, nor does a gram of over ``ITEMS_OF_GRAM`` items where
    an item has enough others."""

    def __init__(self, items: list[bytes], similarity: float):
        self.width = gram_bytes(len(items[0]))
        self.sizes = np.array([len(x) for x in items], np.int64)
        buf = np.frombuffer(b"".join(items), np.uint8)
        first = np.cumsum(self.sizes) - self.sizes
        h = grams(buf, self.width)
        item = np.repeat(np.arange(len(items)), self.sizes)[: len(h)]
        place = np.arange(len(h)) - first[item]
        inside = place + self.width <= self.sizes[item]
        h, item, place = h[inside], item[inside], place[inside]
        order = np.lexsort((place, item, h))
        h, item, place = h[order], item[order], place[order]
        pair = np.concatenate([[True], (h[1:] != h[:-1]) | (item[1:] != item[:-1])])
        nth = np.arange(len(h)) - np.flatnonzero(pair)[np.cumsum(pair) - 1]
        gram = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        common = np.bincount(gram[pair])[gram] > ITEMS_OF_GRAM
        grams_of = np.maximum(self.sizes - self.width + 1, 1)
        rare = np.bincount(item[~common & (nth < PLACES)], minlength=len(items)) / grams_of
        kept = (nth < PLACES) & (~common | (rare < 0.5)[item])
        share = np.bincount(item[kept], minlength=len(items)) / grams_of
        self.least = np.array([max(2, int(least_votes(int(m), self.width, similarity) * min(1.0, s))) for m, s in zip(self.sizes, share, strict=True)], np.int64)
        self.drift = np.array([drift(int(m)) for m in self.sizes], np.int64)
        self.item, self.place = item[kept].astype(np.int32), place[kept].astype(np.int32)
        self.known, self.begin = np.unique(h[kept], return_index=True)
        self.begin = np.append(self.begin, kept.sum())
        self.some = np.zeros(1 << 20, bool)
        self.some[self._short(self.known)] = True

    @staticmethod
    def _short(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(44)

    def windows(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(3, windows): text, start in buf and size; starts are kept inside the text."""
        none = np.zeros((3, 0), np.int64)
        h = grams(buf, self.width)
        at = np.flatnonzero(self.some[self._short(h)])
        if not len(at) or not len(self.known):
            return none
        found = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        same = self.known[found] == h[at]
        at, found = at[same], found[same]
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + self.width <= offsets[text + 1]
        at, found, text = at[inside], found[inside], text[inside]
        n = self.begin[found + 1] - self.begin[found]
        vote = np.repeat(self.begin[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, text, item, place = np.repeat(at, n), np.repeat(text, n), self.item[vote].astype(np.int64), self.place[vote].astype(np.int64)
        # votes by text, item and start; starts before the buffer are shifted up
        far = int(self.sizes.max())
        span = len(buf) + 2 * far + 2
        # text and item as the number of their pair, so that keys stay small; starts of different pairs lie further apart than any drift
        pair, start = text * len(self.sizes) + item, at - place + far
        key = pair * span + start
        order = np.argsort(key, kind="stable")
        key, pair, start, place = key[order], pair[order], start[order], place[order]
        item = pair % len(self.sizes)
        last = np.searchsorted(key, key + self.drift[item], "left")
        dense = np.flatnonzero(last - np.arange(len(key)) >= self.least[item])
        if not len(dense):
            return none
        # votes that stand in a dense stretch
        mark = np.zeros(len(key) + 1, np.int64)
        np.add.at(mark, dense, 1)
        np.add.at(mark, last[dense], -1)
        voted = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        pair, start, place, item = pair[voted], start[voted], place[voted], item[voted]
        m = self.sizes[item]
        cell = pair * span + start // self.drift[item]
        chosen = []
        # the commonest start of a cell, and those of the item's first and last third: insertions and deletions shift one end against the other
        for part in (slice(None), 3 * place < m, 3 * place >= 2 * m):
            c, s, p = cell[part], start[part], pair[part]
            if not len(c):
                continue
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(c)))
            c, s, p = c[head], s[head], p[head]
            best = np.lexsort((-count, c))
            top = best[np.concatenate([[True], c[best][1:] != c[best][:-1]])]
            chosen.append(np.stack([p[top], s[top] - far]))
        pair, start = np.unique(np.concatenate(chosen, axis=1), axis=1)
        text, size = pair // len(self.sizes), self.sizes[pair % len(self.sizes)]
        # a text much shorter than the item can't hold it; one a little shorter is a window of its own
        long = 2 * (offsets[text + 1] - offsets[text]) >= size
        text, start, size = text[long], start[long], size[long]
        return np.stack([text, np.clip(start, offsets[text], np.maximum(offsets[text + 1] - size, offsets[text])), size])


def votes_of(items: list[bytes], similarity: float) -> list[Votes]:
    kinds: dict[int, list[bytes]] = {}
    for x in sorted(set(items)):
        kinds.setdefault(gram_bytes(len(x)), []).append(x)
    return [Votes(own, similarity) for own in kinds.values()]


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, start, n_bytes, distance, similarity): the best match of
    each contaminated document with each item; start and n_bytes locate the
    verified window in the document's normal form."""
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = None
    for block in _blocks(asked):
        part = _against(docs, block, similarity, recall, id_col)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "n_bytes", "similarity")).alias("m"))
    return best.select("doc_id", "item_id", "m.start", "m.n_bytes", "m.distance", "m.similarity")


def _blocks(asked: DataFrame):
    """The query set in blocks of ``ITEM_BLOCK_BYTES``; the driver holds one."""
    block: list[tuple[int | None, bytes]] = []
    size, some = 0, False
    for row in asked.toLocalIterator():
        raw = np.frombuffer(row.text.encode(), np.uint8)
        text = normal(raw, np.array([0, len(raw)]))[0].tobytes() if len(raw) else b""
        if not text:
            continue
        if size + len(text) > ITEM_BLOCK_BYTES and block:
            yield block
            block, size, some = [], 0, True
        block.append((row.item_id, text))
        size += len(text)
    if block or not some:
        yield block


def _against(docs: DataFrame, block: list[tuple[int | None, bytes]], similarity: float, recall: float, id_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = [t for _, t in block]
    # ITEM_BLOCK_BYTES of text and their grams: bounded
    shared = spark.sparkContext.broadcast((texts, votes_of([t for t in texts if len(t) >= SHORT_BYTES], similarity), sorted({t for t in texts if len(t) < SHORT_BYTES})))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def short_matches(raw, offsets, short):
        """Short items are found as they are; one key says which."""
        for t in short:
            at = raw.find(t)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(t) <= offsets[d + 1]:
                    yield d, at, t
                at = raw.find(t, at + 1)

    def propose(batches):
        _, votes, short = shared.value
        for whole in batches:
            doc, start, wide, lead, sizes, strings, row = [], [], [], [], [], [], 0
            short_rows = []
            for batch in slices(whole, "text", SLICE_BYTES):
                buf, offsets = normal(*utf8(batch.column(1)))
                text, begin, size = np.unique(np.concatenate([np.zeros((3, 0), np.int64), *(v.windows(buf, offsets) for v in votes)], axis=1), axis=1)
                raw = buf.tobytes()
                for t, b, z in zip(text.tolist(), begin.tolist(), size.tolist(), strict=True):
                    first, end, slack = int(offsets[t]), int(offsets[t + 1]), z // 4 + 4
                    a = max(first, b - slack)
                    doc.append(row + t)
                    start.append(b - first)
                    lead.append(a - b)
                    wide.append(raw[a : min(end, b + z + slack)])
                    sizes.append(z)
                    strings.append(raw[b : min(end, b + z)])
                short_rows += [(row + d, at - int(offsets[d]), t) for d, at, t in short_matches(raw, offsets, short)]
                row += len(batch)
            fits = np.array([len(x) for x in strings], np.int64)
            keys = cgk_keys(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(fits) - fits, np.array(sizes, np.int64), fits, recall)
            keys = [*keys.view(np.int64), *(_short_key(t) for _, _, t in short_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    whole.column(0).take(pa.array([*doc, *(d for d, _, _ in short_rows)], pa.int64())),
                    pa.array([*start, *(b for _, b, _ in short_rows)], pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array([*wide, *(t for _, _, t in short_rows)], pa.binary()),
                    pa.array([*lead, *(0 for _ in short_rows)], pa.int32()),
                ],
                ["doc_id", "start", "keys", "wide", "lead"],
            )

    windows = rows.mapInArrow(propose, "doc_id long, start long, keys array<long>, wide binary, lead int")
    long_items = [n for n, t in enumerate(texts) if len(t) >= SHORT_BYTES]
    sizes = np.array([len(texts[n]) for n in long_items], np.int64)
    item_keys = cgk_keys(np.frombuffer(b"".join(texts[n] for n in long_items), np.uint8), np.cumsum(sizes) - sizes, sizes, recall=recall).view(np.int64)
    data = [(n, block[n][0], k.tolist()) for n, k in zip(long_items, item_keys, strict=True)] + [(n, block[n][0], _short_key(t).tolist()) for n, t in enumerate(texts) if len(t) < SHORT_BYTES]
    indexed = spark.createDataFrame(data, "item int, item_id long, keys array<long>").select("item", "item_id", F.explode("keys").alias("key"))
    # a window meets an item once, however many keys they share; the index is of one block's items, so bounded
    met = windows.select("doc_id", "start", "wide", "lead", F.explode("keys").alias("key")).join(F.broadcast(indexed), "key")
    met = met.select("doc_id", "start", "wide", "lead", "item_id", "item").distinct()

    def verify(batches):
        texts = shared.value[0]
        done: dict = {}
        for batch in batches:
            out = {c: [] for c in ("doc_id", "item_id", "start", "n_bytes", "distance", "similarity")}
            for doc, start, wide, lead, item_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, item = (wide, n), texts[n]
                if key not in done:
                    if len(done) > 20_000:
                        done.clear()
                    most = int((1 - similarity) * len(item) + 1e-9) if len(item) >= SHORT_BYTES else 0
                    done[key] = edit_distance_within(item, wide, most)
                if done[key] is not None:
                    distance, end = done[key]
                    begin = max(0, end - len(item))
                    for c, v in zip(out, (doc, item_id, start + lead + begin, end - begin, distance, 1 - distance / len(item)), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], list(out))

    return met.mapInArrow(verify, "doc_id long, item_id long, start long, n_bytes long, distance int, similarity double")


def _short_key(text: bytes) -> np.ndarray:
    value = len(text)
    for c in text:
        value = (value * 257 + c + 1) & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([value], np.uint64)).view(np.int64)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, told apart by a hash of
    their id and text: rows without id or with one id have fates of their own."""
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    found = contaminated(keyed, items, id_col="row_key").select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(found, "row_key", "left_anti").select(*docs.columns)
