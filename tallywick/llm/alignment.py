"""Operator 12: alignment of two tokenizers' tokens over a corpus.

Side A encodes space+text by a byte-level BPE file, side B the text by a
sentencepiece model, which adds the space itself.  Byte offsets where tokens of
both sides end cut them into groups; every A token and every B token of a group
are linked.

*Units.*  A text is cut before each space that follows a character other than
white space.  No token of either side crosses such a place (A's pre-tokens end
there; no piece of B has a space after another character, which is checked), so
a unit's tokens, groups and links don't depend on its neighbours: they are found
once for each distinct unit of a task and looked up after that.

*Id-striped count matrices.*  The pairs that a block of documents links go, a
document's distinct pairs once each, to the stripe of their A id.  For a stripe
(``STRIPE`` ids times all B ids) partial counts of the tasks are added up in a
dense matrix by ``np.add.at``; the maximum of each row is the count of the id's
best partners.  Links are scored where their stripe's matrix is: a stripe whose
links are many is dealt out over pieces of ``PIECE_PAIRS``, each with the
matrix.  What a block's documents score comes back packed, one row a stripe.

Nulls, empty texts and texts whose joined token bytes on either side differ from
space+text have no tokens: zeros and the empty digest.  Rows with the same id or
text each keep a row of their own and count as documents of their own.  Long
texts are read in segments that end where units do.  Further columns are
ignored, clashing names included; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices
from .shared import written
from .vocab import bpe, vocabulary_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
STRIPE = 256
BLOCK_BYTES = 1 << 20
SEGMENT_CHARS = 1 << 20
PIECE_PAIRS = 1 << 20
#: Distinct units, and characters of them, that a task remembers.
MEMO_UNITS, MEMO_CHARS = 300_000, 1 << 24
#: Pairs that are expanded at a time.
EXPAND = 1 << 22
PARTIAL_PAIRS = 1 << 21

_CUT = re.compile(r"(?<=\S)(?= )")
#: White space before a space: units there are longer than what stands between two spaces.
_WIDE = re.compile(r"(?:^|\s) ")

DOCUMENT = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]
)


def units(segment: str) -> list[str]:
    """The segment's units, each without its leading space."""
    if _WIDE.search(segment):
        return [u[1:] for u in _CUT.split(" " + segment)]
    return segment.split(" ")


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text in segments of about ``limit`` characters that end where units
    do; the space that opens a unit is left out between segments."""
    at = 0
    while len(text) - at > limit and (m := _CUT.search(text, at + limit)):
        yield text[at : m.start()]
        at = m.start() + 1
    yield text[at:]


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers in the narrowest type that holds them all."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << (8 * int(t[2])))).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each key's weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(weights[order], at)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one range after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


class Units:
    """What a task knows about the units it has met."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary_path(a_file))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.a_bytes = bpe(a_file).token_bytes
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b_file))
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"pieces of {b_file} cross the places where units end")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_space = b.piece_to_id("▁")
        self.a_len, self.b_len = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.bits = (len(pieces) - 1).bit_length()
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.met = np.zeros(0, np.int64)  # in how many blocks
        self.text: list[str] = []  # a unit's groups as the digest has them
        self.stats = np.zeros((0, 5), np.int64)  # whether the bytes agree, n_a, n_b, n_groups, n_links
        self.first = np.zeros(1, np.int64)  # where a unit's pairs begin
        self.pair, self.weight = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forgets the units that have been met once; all of them if that frees
        less than half."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > MEMO_UNITS // 2:
            self.forget()
            return
        place = np.full(len(self.text), -1, np.int64)
        place[keep] = np.arange(len(keep))
        lens = np.diff(self.first)[keep]
        at = ranges(self.first[keep], lens)
        self.index = {u: k for u, i in self.index.items() if (k := int(place[i])) >= 0}
        self.chars = sum(map(len, self.index))
        self.text = [self.text[i] for i in keep.tolist()]
        self.stats, self.pair, self.weight = self.stats[keep], self.pair[at], self.weight[at]
        self.first = np.concatenate([[0], np.cumsum(lens)])
        self.met = np.ones(len(keep), np.int64)  # to be met again before the next time

    def learn(self, new: list[str]) -> None:
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)]
        b_ids = [x or [self.b_space] for x in self.b.encode(new, num_threads=1)]
        good = []
        for u, x, y in zip(new, a_ids, b_ids, strict=True):
            raw = (" " + u).encode()
            good.append(b"".join([self.a_bytes[i] for i in x]) == raw and b"".join([self.b_bytes[i] for i in y]) == raw)
        take = [(x, y) for x, y, g in zip(a_ids, b_ids, good, strict=True) if g]
        n_a, n_b = (np.array([len(t[k]) for t in take], np.int64) for k in (0, 1))
        a, b = (np.array([i for t in take for i in t[k]], np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        cuts = a_end[np.isin(a_end, b_end)]
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        in_a, in_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        to_group = np.searchsorted(cuts, a_end[np.cumsum(n_a) - 1], "right") if take else np.zeros(0, np.int64)
        from_group = np.concatenate([[0], to_group[:-1]]) if take else to_group
        links = np.concatenate([[0], np.cumsum(in_a * in_b)])

        stats = np.zeros((len(new), 5), np.int64)
        at = np.flatnonzero(good)
        stats[at] = np.column_stack([np.ones(len(at), np.int64), n_a, n_b, to_group - from_group, links[to_group] - links[from_group]])
        sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_to, b_to = np.cumsum(in_a).tolist(), np.cumsum(in_b).tolist()
        groups = [",".join(sa[p:q]) + "|" + ",".join(sb[r:s]) for p, q, r, s in zip([0, *a_to[:-1]], a_to, [0, *b_to[:-1]], b_to, strict=True)] if take else []
        text = [""] * len(new)
        for k, i, j in zip(at.tolist(), from_group.tolist(), to_group.tolist(), strict=True):
            text[k] = ";".join(groups[i:j])

        unit_of = np.repeat(np.arange(len(take)), to_group - from_group)
        keys, weights = self._pairs(a, a_group, b, b_group, unit_of)
        per = np.zeros(len(new), np.int64)
        per[at] = np.bincount(keys >> 40, minlength=len(at))
        base = len(self.text)
        self.index.update(zip(new, range(base, base + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.text += text
        self.stats = np.concatenate([self.stats, stats])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(per)])
        self.pair = np.concatenate([self.pair, keys & ((1 << 40) - 1)])
        self.weight = np.concatenate([self.weight, weights])

    def _pairs(self, a, a_group, b, b_group, unit_of) -> tuple[np.ndarray, np.ndarray]:
        """(unit << 40 | A id << bits | B id, links): a unit's distinct pairs."""
        one = lambda x: np.ones(len(x), np.int64)
        ga, ca = summed((a_group << 20) | a, one(a))
        gb, cb = summed((b_group << 20) | b, one(b))
        mask = (1 << 20) - 1
        b_first = np.searchsorted(gb >> 20, np.arange(len(unit_of) + 1))
        width = np.diff(b_first)[ga >> 20]  # B ids that each A id of a group meets
        keys, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.cumsum(width)
        i = 0
        while i < len(ga):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + EXPAND, "right")))
            group = ga[i:j] >> 20
            right = ranges(b_first[group], width[i:j])
            left = np.repeat(np.arange(i, j), width[i:j])
            k, w = summed((unit_of[ga[left] >> 20] << 40) | ((ga[left] & mask) << self.bits) | (gb[right] & mask), ca[left] * cb[right])
            keys.append(k)
            weights.append(w)
            i = j
        return summed(np.concatenate(keys), np.concatenate(weights))

    def block(self, texts: list[str]) -> tuple[list, tuple]:
        """The documents' columns (n_a, n_b, n_groups, n_links, digest) and the
        links (stripe, document, A id in its stripe, B id, weight) in order."""
        if len(self.index) > MEMO_UNITS or self.chars > MEMO_CHARS:
            self.shrink()
        whose, which = [], []
        digest = [hashlib.sha256() if t else None for t in texts]
        begun = [False] * len(texts)
        for portion in self._portions(texts):
            cut = [(k, units(s)) for k, s in portion]
            new = {u for _, us in cut for u in us if u not in self.index}
            if new:
                self.learn(sorted(new))
            for k, us in cut:
                at = list(map(self.index.__getitem__, us))
                if begun[k]:
                    digest[k].update(b";")
                begun[k] = True
                digest[k].update(";".join(map(self.text.__getitem__, at)).encode())
                whose.append(np.full(len(at), k, np.int64))
                which.append(np.array(at, np.int64))
        d, u = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (whose, which))
        self.met[np.unique(u)] += 1
        ends = np.searchsorted(d, np.arange(len(texts) + 1))
        total = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.stats[u], axis=0)])
        sums = total[ends[1:]] - total[ends[:-1]]
        good = (sums[:, 0] == np.diff(ends)) & (np.diff(ends) > 0)
        sums[~good] = 0
        columns = [*(sums[:, c] for c in range(1, 5)), [h.hexdigest() if g else "" for h, g in zip(digest, good, strict=True)]]

        keep = good[d]
        key, times = summed((d[keep] << 32) | u[keep], np.ones(int(keep.sum()), np.int64))
        d, u = key >> 32, key & 0xFFFFFFFF
        lens = self.first[u + 1] - self.first[u]
        at = ranges(self.first[u], lens)
        pair, weight = self.pair[at], self.weight[at] * np.repeat(times, lens)
        a, b = pair >> self.bits, pair & ((1 << self.bits) - 1)
        low = 8 + self.bits
        span = max(1, (len(texts) - 1).bit_length())
        key, weight = summed(((a // STRIPE) << (low + span)) | (np.repeat(d, lens) << low) | ((a % STRIPE) << self.bits) | b, weight)
        b = key & ((1 << self.bits) - 1)
        return columns, (key >> (low + span), (key >> low) & ((1 << span) - 1), (key >> self.bits) & 255, b, weight)

    @staticmethod
    def _portions(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        some, size = [], 0
        for k, text in enumerate(texts):
            if text:
                for s in segments(text):
                    some.append((k, s))
                    size += len(s)
                    if size >= SEGMENT_CHARS:
                        yield some
                        some, size = [], 0
        if some:
            yield some


@lru_cache(1)
def known_units(a_file: str, b_file: str) -> Units:
    return Units(a_file, b_file)


def links(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of encoded documents, written to the shared folder: for each block
    one row of its documents (stripe -1) and one row of links for each stripe
    that they touch."""

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = known_units(a_file, b_file)
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                columns, (stripe, d, a, b, w) = known.block([t or "" for t in batch.column(1).to_pylist()])
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, DOCUMENT) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], schema=DOCUMENT))
                cuts = np.flatnonzero(np.diff(stripe)) + 1
                starts = np.concatenate([[0], cuts]) if len(stripe) else cuts
                stops = np.append(cuts, len(stripe)) if len(stripe) else cuts
                rows = [(block, -1, batch.num_rows, None, None, None, None, sink.getvalue())]
                rows += [(block, int(stripe[i]), int(j - i), packed(d[i:j]), packed(a[i:j]), packed(b[i:j]), packed(w[i:j]), None) for i, j in zip(starts, stops, strict=True)]
                kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "stripe", "n", "d", "a", "b", "w", "docs"])
                block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "block long, stripe int, n long, d binary, a binary, b binary, w binary, docs binary"), "links")


def count_matrices(linked: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(stripe, n, a, b, times, top, total): in how many documents each pair of a
    stripe is linked, the maximum of each A id, the sum over pairs."""

    def partial(batches):
        bits = known_units(a_file, b_file).bits
        held, sizes, acc, n = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def fold():
            new = np.concatenate(held)
            return summed(np.concatenate([acc, new]), np.concatenate([n, np.ones(len(new), np.int64)]))

        def flush():
            stripe = acc >> (8 + bits)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(stripe)) + 1, [len(acc)]]) if len(acc) else np.zeros(1, np.int64)
            rows = [(int(stripe[i]), int(j - i), packed(acc[i:j] & ((1 << (8 + bits)) - 1)), packed(n[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_pylist([dict(zip(("stripe", "n", "pair", "times"), r, strict=True)) for r in rows], pa.schema([("stripe", pa.int32()), ("n", pa.int64()), ("pair", pa.binary()), ("times", pa.binary())]))

        for batch in batches:
            for r in batch.to_pylist():
                held.append((r["stripe"] << (8 + bits)) | (unpacked(r["a"], r["n"]) << bits) | unpacked(r["b"], r["n"]))
                sizes += r["n"]
                if sizes > PARTIAL_PAIRS:
                    acc, n = fold()
                    held, sizes = [], 0
                    if len(acc) > 2 * PARTIAL_PAIRS:
                        yield flush()
                        acc, n = acc[:0], n[:0]
        if held:
            acc, n = fold()
        if len(acc):
            yield flush()

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known_units(a_file, b_file).bits
        matrix, stripe = np.zeros((STRIPE, 1 << bits), np.int64), 0
        for batch in batches:
            for r in batch.to_pylist():
                stripe, pair = r["stripe"], unpacked(r["pair"], r["n"])
                np.add.at(matrix, (pair >> bits, pair & ((1 << bits) - 1)), unpacked(r["times"], r["n"]))
        a, b = np.nonzero(matrix)
        times = matrix[a, b]
        yield pa.RecordBatch.from_pylist(
            [{"stripe": stripe, "n": len(a), "a": packed(a), "b": packed(b), "times": packed(times), "top": packed(matrix.max(1)), "total": int(times.sum())}],
            pa.schema([("stripe", pa.int32()), ("n", pa.int64()), *((c, pa.binary()) for c in ("a", "b", "times", "top")), ("total", pa.int64())]),
        )

    parts = linked.where("stripe >= 0").select("stripe", "n", "a", "b").mapInArrow(partial, "stripe int, n long, pair binary, times binary")
    return written(parts.groupBy("stripe").applyInArrow(dense, "stripe int, n long, a binary, b binary, times binary, top binary, total long"), "pair-counts")


def pair_counts(matrices: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, best): the matrices as rows, one for each linked pair
    of ids; ``best`` marks the B ids that most documents link to the A id."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b, times, top = unpacked(r["a"], r["n"]), unpacked(r["b"], r["n"]), unpacked(r["times"], r["n"]), unpacked(r["top"], STRIPE)
                yield pa.RecordBatch.from_arrays([pa.array(a + r["stripe"] * STRIPE), pa.array(b), pa.array(times), pa.array(times == top[a])], ["a_id", "b_id", "n_docs", "best"])

    return matrices.mapInArrow(run, "a_id long, b_id long, n_docs long, best boolean")


def scored(linked: DataFrame, matrices: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per document: counts of tokens, groups and links, ``n_best``,
    ``count_sum`` and the digest of its groups."""
    # at most one row a stripe: some 200
    pieces = matrices.select("stripe", F.ceil(F.col("total") / F.lit(PIECE_PAIRS)).cast("int").alias("pieces"))
    dealt = linked.where("stripe >= 0").select("block", "stripe", "n", "d", "a", "b", "w").join(F.broadcast(pieces), "stripe").withColumn("piece", F.pmod(F.xxhash64("block"), "pieces").cast("int"))
    spread = matrices.join(F.broadcast(pieces), "stripe").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("stripe", "piece", "n", "a", "b", "times", "top")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"block": [], "n": [], "d": [], "n_best": [], "count_sum": []}
        if left.num_rows:
            bits = known_units(a_file, b_file).bits
            m = right.to_pylist()[0]
            matrix, top = np.zeros((STRIPE, 1 << bits), np.int64), unpacked(m["top"], STRIPE)
            matrix[unpacked(m["a"], m["n"]), unpacked(m["b"], m["n"])] = unpacked(m["times"], m["n"])
            for batch in left.to_batches():
                for r in batch.to_pylist():
                    d, a, b, w = (unpacked(r[c], r["n"]) for c in ("d", "a", "b", "w"))
                    times = matrix[a, b]
                    at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                    for name, value in (("block", r["block"]), ("n", len(at)), ("d", packed(d[at])), ("n_best", packed(np.add.reduceat(w * (times == top[a]), at))), ("count_sum", packed(np.add.reduceat(w * times, at)))):
                        found[name].append(value)
        return pa.table({c: pa.array(v, pa.int64() if c in ("block", "n") else pa.binary()) for c, v in found.items()})

    sums = dealt.groupBy("stripe", "piece").cogroup(spread.groupBy("stripe", "piece")).applyInArrow(score, "block long, n long, d binary, n_best binary, count_sum binary")
    both = sums.withColumn("docs", F.lit(None).cast("binary")).unionByName(linked.where("stripe < 0").select("block", "n", "docs"), allowMissingColumns=True)

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        docs = next(pa.ipc.open_stream(r["docs"]).read_all() for r in rows if r["docs"] is not None)
        n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        for r in rows:
            if r["docs"] is None:
                d = unpacked(r["d"], r["n"])
                n_best[d] += unpacked(r["n_best"], r["n"])
                count_sum[d] += unpacked(r["count_sum"], r["n"])
        return docs.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)).select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return both.groupBy("block").applyInArrow(gather, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, see :func:`scored`."""
    linked = links(docs, a_file, b_file, id_col, text_col)
    return scored(linked, count_matrices(linked, a_file, b_file), a_file, b_file)
