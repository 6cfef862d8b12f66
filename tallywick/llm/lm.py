"""Operator 7: language-model scoring.

*Subwords.*  A word is the byte-level BPE ids of its bytes; the last id of a word
is marked as final, so words are prefix-free sequences of 2 V ids, and one more
id ends the text.

*Model.*  Causal self-attention over the embeddings of the last subwords (with a
learned bias for each distance), then a hidden layer that weighs a fixed number
of subword distributions: p(id) = sum_k pi_k(context) M_k(id).  The network's
weights are trained in numpy by adaptive gradient steps.  A few texts
(``SAMPLE_DOCS`` of least id hash; fewer, but one at least, once these have
``SAMPLE_BYTES``) give all tasks the same start.  All training texts are then dealt
out in blocks, in which copies of the network go on, a step for about ``STEP_IDS``
subwords, until each text is learned from (:class:`Walk`); the copies' movements are
averaged.  The expected counts that the texts have on this way give the distributions
(incremental expectation-maximisation).  A word's probability is the
mixture of its share of all training tokens and the product of its subwords'
probabilities.  After one in ``MEMORY`` pairs of words (by hash, the same ones in
all texts) the model also knows which words followed in the training texts and
how often.  All three parts grow with the corpus, and together they are a proper
distribution over words: nothing has probability 0.

*Scoring.*  Windows overlap: each holds ``SPAN`` new subwords after ``SPAN`` + 1
subwords of context; each subword is scored once, many windows in one masked
batch.

*Counts.*  Texts are dealt out in blocks of bounded bytes, equal rows of a batch
as one row with their number; a block sends each of its distinct keys (words,
remembered contexts, words in them) once, with its count in training texts, to
the key's bucket and gets the corpus' count back where it differs.  So a frequent
word makes one row per block at most, and no vocabulary is held anywhere whole.
Keys are 62-bit hashes.

Nulls and empty texts have the end token alone.  Rows with the same id each keep
a row; without training rows the counts are 0 and the model is uniform; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import lower, mix, one_thread, slices, span_hashes, utf8, words
from .shared import block_count, collapsed, expanded
from .vocab import bpe

TOKENIZER = "byte_bpe_50k.json"
WIDTH, HIDDEN, EXPERTS, SPAN = 16, 32, 64, 16
SAMPLE_DOCS, EPOCHS, BATCH, RATE = 1000, 3, 128, 0.2
#: Texts join the network's training until those before have so many bytes.
SAMPLE_BYTES = 16 << 20
#: The corpus share's part in a word's probability.
SHARE = 0.3
#: One in so many contexts of two words is remembered; how often it must stand to weigh as much as the rest.
MEMORY, TRUST = 8, 2.0
#: Expected counts are added as whole numbers of 1/PARTS, by CHUNK ids.
PARTS, CHUNK = 1 << 14, 512
#: Movements of the network are added as whole numbers of 1/STEPS.
STEPS = 1 << 14
#: Subwords of a step, and bytes of texts that one copy of the network learns from.
STEP_IDS, LEARN_BYTES = 1 << 13, 16 << 20
#: Steps after which a copy's distributions follow its counts, and ids that those of the start count as.
RENEW, ANCHOR = 16, 1 << 16
BLOCK_BYTES, PART_BYTES = 8 << 20, 1 << 18
END_KEY, START_KEY = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0xB0A0B0A0B0A0B0A1)
_KIND = ~np.uint64(3)
#: Bytes of text that the library takes at a time; words whose ids a process remembers.
PIECE_BYTES, MEMO_WORDS = 1 << 20, 1 << 16
#: What a word is.
WORD = r"[^\x20\x09-\x0D]+"


class Subwords:
    """Ids of words, each word's last id marked by adding the vocabulary's size;
    ``end`` ends a text and ``pad`` stands before it.  Each word is merged as one
    piece, by the library that takes a vocabulary as ranks."""

    def __init__(self, tokenizer: str = TOKENIZER):
        import tiktoken

        model = bpe(tokenizer)
        ranks = {b: i for i, b in enumerate(model.token_bytes) if i not in model.special.values()}
        self.library = tiktoken.Encoding("words", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.length = np.array([len(b) for b in model.token_bytes[: self.size]])
        self.end, self.pad = 2 * self.size, 2 * self.size + 1
        # words met before: hashes (sorted), where their ids stand in the pool, how many they are
        self.known, self.at, self.many, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([self.end], np.int32)

    def _spell(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of the words, marked at their ends."""
        size = ends - starts + 1
        to = np.cumsum(size)
        apart = np.full(to[-1] if len(to) else 0, 0x20, np.uint8)  # a gap after each word
        inside = np.ones(len(apart), bool)
        inside[to - 1] = False
        apart[inside] = buf[(np.arange(len(apart)) + np.repeat(starts - to + size, size))[inside]]
        at, ids = 0, []
        while at < len(to):
            begin = to[at] - size[at]
            stop = max(at + 1, int(np.searchsorted(to, begin + PIECE_BYTES, "right")))
            ids.append(np.array(self.library.encode_ordinary(apart[begin : to[stop - 1]].tobytes().decode()), np.int32))
            at = stop
        ids = np.concatenate([np.zeros(0, np.int32), *ids])
        last = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(size - 1))
        ids[last] += self.size
        return ids, np.diff(last, prepend=-1)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each text, first id of each word or end) of
        lower-cased texts, totals at the ends of both; every text ends with ``end``.
        A word (by 64 bits of hash) goes to the library once a call, and not at all
        if it is one of the first ``MEMO_WORDS`` that the process has met."""
        starts, ends, first = words(buf, offsets)
        met, at, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, met)
        new = np.flatnonzero(np.append(self.known, np.uint64(0))[place] != met) if len(self.known) else np.arange(len(met))
        ids, size = self._spell(buf, starts[at[new]], ends[at[new]])
        known, pool = self.known, np.concatenate([self.pool, ids])
        where = np.insert(self.at, place[new], len(self.pool) + np.cumsum(size) - size)
        many = np.insert(self.many, place[new], size)
        if len(known) + len(new) <= MEMO_WORDS:
            self.known, self.at, self.many, self.pool = np.insert(known, place[new], met[new]), where, many, pool
        # a word's place among those known and new
        place += np.searchsorted(new, np.arange(len(met)))
        n = np.insert(many[place][which], first[1:], 1)
        begin = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(begin[-1]) + np.repeat(np.insert(where[place][which], first[1:], 0) - begin[:-1], n)]
        return ids, begin[first + np.arange(len(first))], begin


@lru_cache(2)
def subwords(tokenizer: str) -> Subwords:
    return Subwords(tokenizer)


def windows(ids: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that start at ``first`` in ``ids`` (the total at its end):
    inputs (n, 2 SPAN), targets (n, SPAN) and the targets' places in ids (-1:
    past the text's end).  Every id is a target once."""
    size = np.diff(first)
    n = -(-size // SPAN)
    text = np.repeat(np.arange(len(size)), n)
    begin = first[text] + SPAN * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    place = begin[:, None] + np.arange(SPAN)
    place = np.where(place < first[text + 1][:, None], place, -1)
    back = begin[:, None] + np.arange(-SPAN - 1, SPAN - 1)
    inside = (back >= first[text][:, None]) & (back < first[text + 1][:, None])
    inputs = np.where(inside, ids[np.clip(back, 0, max(len(ids) - 1, 0))], pad)
    return inputs, np.where(place >= 0, ids[np.maximum(place, 0)], pad), place


_MASK = np.where(np.arange(2 * SPAN)[None, :] <= SPAN + np.arange(SPAN)[:, None], 0.0, -1e9).astype(np.float32)


class Attention:
    """Parameters as float32 arrays, the forward pass and training."""

    NAMES = ("emb", "q", "k", "v", "o", "bias", "w", "b", "u", "c")

    def __init__(self, ids: int, seed: int = 0, arrays: dict | None = None):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        d = WIDTH
        self.p = arrays or {
            "emb": rng.normal(0, 0.5, (ids + 2, d)).astype(np.float32),
            **{n: r(d, d) for n in "qkvo"},
            "bias": np.zeros((SPAN, 2 * SPAN), np.float32),
            "w": r(d, HIDDEN),
            "b": np.zeros(HIDDEN, np.float32),
            "u": r(HIDDEN, EXPERTS),
            "c": np.zeros(EXPERTS, np.float32),
            "m": np.full((ids + 2, EXPERTS), 1.0 / (ids + 1), np.float32),
        }

    def forward(self, inputs: np.ndarray, keep: bool = False):
        weights, *rest = self._forward(inputs)
        weights /= weights.sum(axis=1, keepdims=True)
        return (weights, *rest) if keep else weights

    def _forward(self, inputs: np.ndarray):
        """Weights of the distributions at every target, not yet divided by their
        sum, and what the backward pass needs."""
        p = self.p
        n = len(inputs)
        x = p["emb"][inputs.ravel()]
        k, v = (x @ p["k"]).reshape(n, 2 * SPAN, -1), (x @ p["v"]).reshape(n, 2 * SPAN, -1)
        xq = np.ascontiguousarray(x.reshape(n, 2 * SPAN, -1)[:, SPAN:]).reshape(n * SPAN, -1)
        q = (xq @ (p["q"] * np.float32(WIDTH**-0.5))).reshape(n, SPAN, -1)
        s = q @ k.transpose(0, 2, 1)
        s += p["bias"] + _MASK
        np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        total = (s.reshape(-1, 2 * SPAN) @ np.ones(2 * SPAN, np.float32) + np.float32(1e-20)).reshape(n, SPAN, 1)
        s /= total
        av = (s @ v).reshape(n * SPAN, -1)
        h = xq + av @ p["o"]
        g = h @ p["w"]
        g += p["b"]
        np.tanh(g, out=g)
        logit = g @ p["u"]
        logit += p["c"]
        if (np.abs(p["u"]).sum(axis=0) + np.abs(p["c"])).max() > 60:  # else exp can't overflow, as g is in -1..1
            logit -= logit.max(axis=1, keepdims=True)
        np.exp(logit, out=logit)
        return logit, x, xq, q, k, v, s, av, h, g

    def learn(self, ids: np.ndarray, first: np.ndarray, pad: int, seed: int = 0) -> None:
        """``EPOCHS`` passes over the texts' windows."""
        inputs, targets, place = windows(ids, first, pad)
        rng = np.random.default_rng(seed)
        n_ids = len(self.p["m"]) - 1
        counts = np.bincount(ids, minlength=n_ids + 1).astype(np.float64)
        prior = (counts + 0.02) / (counts + 0.02).sum()
        prior[pad] = 0
        prior /= prior.sum()
        noise = np.exp(rng.normal(0, 0.7, (n_ids + 1, EXPERTS)))
        m = prior[:, None] * noise
        self.p["m"] = (m / m.sum(axis=0)).astype(np.float32)
        seen = np.zeros((n_ids + 1, EXPERTS), np.float32)
        squares = self.squares = {k: np.full_like(self.p[k], 1e-6) for k in self.NAMES}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(inputs))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                y, live = targets[own].ravel(), (place[own] >= 0).ravel()
                seen_now = self._step(inputs[own], y, live, squares)
                np.add.at(seen, y[live], seen_now)
                step += 1
                if step % 50 == 0 or lo + BATCH >= len(order):
                    total = seen + np.float32(2.0) * self.p["m"] * (step < 200) + (prior[:, None] * (0.02 * seen.sum(axis=0) + 1.0)).astype(np.float32)
                    self.p["m"] = (total / total.sum(axis=0)).astype(np.float32)
                    if step < 200 * (epoch == 0):
                        seen *= np.float32(0.7)

    def _step(self, inputs, y, live, squares) -> np.ndarray:
        p = self.p
        n = len(inputs)
        pi, x, xq, q, k, v, a, av, h, g = self.forward(inputs, keep=True)
        joint = pi * p["m"][y]
        resp = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        d_logit = (pi - resp) * (live / np.float32(max(1, live.sum())))[:, None]
        grad = {"u": g.T @ d_logit, "c": d_logit.sum(axis=0)}
        dz = (d_logit @ p["u"].T) * (1 - g * g)
        grad |= {"w": h.T @ dz, "b": dz.sum(axis=0)}
        dh = dz @ p["w"].T
        grad["o"] = av.T @ dh
        dav = (dh @ p["o"].T).reshape(n, SPAN, -1)
        da = dav @ v.transpose(0, 2, 1)
        dv = (a.transpose(0, 2, 1) @ dav).reshape(n * 2 * SPAN, -1)
        ds = a * (da - (da * a).sum(axis=2, keepdims=True))
        grad["bias"] = ds.sum(axis=0)
        dq = (ds @ k).reshape(n * SPAN, -1) * np.float32(WIDTH**-0.5)
        dk = (ds.transpose(0, 2, 1) @ q).reshape(n * 2 * SPAN, -1)
        grad |= {"q": xq.T @ dq, "k": x.T @ dk, "v": x.T @ dv}
        dx = (dk @ p["k"].T + dv @ p["v"].T).reshape(n, 2 * SPAN, -1)
        dx[:, SPAN:] += (dh + dq @ p["q"].T).reshape(n, SPAN, -1)
        rows, at = np.unique(inputs, return_inverse=True)
        at = at.ravel()
        order = np.argsort(at, kind="stable")
        d_emb = np.add.reduceat(dx.reshape(-1, WIDTH)[order], np.searchsorted(at[order], np.arange(len(rows))), axis=0)
        for name, gr in grad.items():
            squares[name] += gr * gr
            p[name] -= np.float32(RATE) * gr / np.sqrt(squares[name])
        squares["emb"][rows] += d_emb * d_emb
        p["emb"][rows] -= np.float32(RATE) * d_emb / np.sqrt(squares["emb"][rows])
        return resp[live]


KEY = ["d0", "d1", "d2"]


def sampled(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, int | None]:
    """(``KEY`` and text of the rows to train on, the last one's id hash).  The
    driver sees keys and sizes of ``sample_docs`` rows; no text is sorted but those
    chosen."""
    # rows, not ids, are chosen, so that repeated ids don't widen the sample
    keyed = rows.select(F.xxhash64("doc_id").alias("d0"), F.col("doc_id").alias("d1"), F.xxhash64("text").alias("d2"), "text")
    chosen, held = [], 0
    for r in keyed.select(*KEY, F.octet_length("text").alias("size")).orderBy(*KEY).limit(sample_docs).collect():
        if held >= sample_bytes:
            break
        chosen.append(r)
        held += r.size
    if not chosen:
        return keyed.limit(0), None
    last = chosen[-1]
    # structs compare as rows are ordered: null ids first
    upto = F.struct(*KEY) <= F.struct(*[F.lit(last[c]).cast("long").alias(c) for c in KEY])
    return keyed.where(upto).orderBy(*KEY).limit(len(chosen)), last.d0


def train(docs: DataFrame, keep: Column, tokenizer: str = TOKENIZER, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """The model's arrays, of all texts for which ``keep`` (over doc_id) is true.  The
    network starts from the ``sample_docs`` texts of least id hash, or as many of
    them as ``SAMPLE_BYTES`` holds, and goes on by small steps over all texts; on this
    way, the distributions are learned from all texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(keep)
    sample, last = sampled(rows, sample_docs)
    if last is None:
        return Attention(subwords(tokenizer).end + 1).p

    def learn(table: pa.Table) -> pa.Table:
        one_thread()
        sub = subwords(tokenizer)
        ids, first = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        # in a fixed order, so that the same rows give the same network
        for batch in table.sort_by([(c, "ascending") for c in KEY]).combine_chunks().to_batches():
            for part in slices(batch, "text"):
                buf, offsets = utf8(part.column("text"))
                i, f, _ = sub.encode(lower(buf), offsets)
                first.append(first[-1][-1] + f[1:])
                ids.append(i)
        ids, first = np.concatenate(ids), np.concatenate(first)
        net = Attention(sub.end + 1)
        net.learn(ids, first, sub.pad)  # every text has its end
        out = net.p | {f"squares_{n}": a for n, a in net.squares.items()}
        return pa.table({"name": list(out), "shape": [list(a.shape) for a in out.values()], "data": [a.astype(np.float16 if a.size > 1 << 16 and n == "emb" else np.float32).tobytes() for n, a in out.items()]})

    got = sample.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: learn(t), "name string, shape array<long>, data binary").collect()
    arrays = {r.name: np.frombuffer(bytes(r.data), np.float16 if r.name == "emb" else np.float32).astype(np.float32).reshape(r.shape) for r in got}
    del got  # as large as the arrays
    arrays["m"] = distributions(rows, arrays, tokenizer)
    return arrays


def distributions(rows: DataFrame, arrays: dict[str, np.ndarray], tokenizer: str = TOKENIZER) -> np.ndarray:
    """Learns from all texts of ``rows``, once each.  The subword distributions are
    returned; in ``arrays`` the network's are replaced by those that it has then, and
    ``tokens`` is the texts' number of words and ends.

    Blocks of texts each start from ``arrays`` and go on by small steps, texts in the
    order of their hash; the network moves by the mean of their movements, weighted by
    ids, and an id's embedding by the mean over the blocks that have it.  A block sends
    the sums of its ids as whole numbers of 1/``PARTS`` (counts) and 1/``STEPS``
    (movements), so that the blocks' order doesn't matter."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = block_count(spark, total, LEARN_BYTES)
    hashed = collapsed(rows.select(F.xxhash64("doc_id", "text").alias("h"), "text")).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    shared = spark.sparkContext.broadcast(arrays)  # 2 V rows of WIDTH and EXPERTS floats: fixed

    def learn(table: pa.Table) -> pa.Table:
        one_thread()
        sub = subwords(tokenizer)
        walk, tokens = Walk(shared.value, sub.pad), 0
        for batch in table.select(["h", "text", "_copies"]).sort_by("h").combine_chunks().to_batches():
            for part in slices(batch, "text", PART_BYTES):
                buf, offsets = utf8(part.column(1))
                copies = np.asarray(part.column(2))
                ids, first, begin = sub.encode(lower(buf), offsets)
                walk.take(ids, first, copies)
                tokens += int(np.diff(np.searchsorted(begin, first)) @ copies)
        out = [(-1, None, None, np.append(np.rint(walk.flat() * STEPS).astype(np.int64), [walk.ids, tokens]).tobytes(), None)]
        used = np.flatnonzero(walk.met)
        for own in np.split(used, np.flatnonzero(np.diff(used // CHUNK)) + 1):
            if len(own):
                values = [np.rint(x).astype(np.int32 if np.abs(x).max() < (1 << 31) - 1 else np.int64).tobytes() for x in (walk.counts(own) * PARTS, walk.moves(own) * STEPS)]
                out.append((int(own[0]) // CHUNK, own.astype(np.int32).tobytes(), walk.met[own].tobytes(), *values))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("chunk", "ids", "met", "sums", "moves"), zip(*out, strict=True), kinds, strict=True)})

    def add(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        if chunk < 0:
            sums, moves = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("sums")), np.zeros(0)
        else:
            met, sums, moves = np.zeros(CHUNK, np.int64), np.zeros((CHUNK, EXPERTS), np.int64), np.zeros((CHUNK, WIDTH), np.int64)
            for i, n, *values in zip(*(table.column(c) for c in ("ids", "met", "sums", "moves")), strict=True):
                i = np.frombuffer(i.as_py(), np.int32) % CHUNK
                met[i] += np.frombuffer(n.as_py(), np.int64)
                for to, x in zip((sums, moves), (v.as_py() for v in values), strict=True):
                    to[i] += np.frombuffer(x, np.int32 if len(x) == 4 * to.shape[1] * len(i) else np.int64).reshape(len(i), -1)
            sums, moves = (sums / PARTS).astype(np.float32), moves / STEPS / np.maximum(met, 1)[:, None]
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "sums": [sums.tobytes()], "moves": [moves.astype(np.float32).tobytes()]})

    found = hashed.groupBy("block").applyInArrow(learn, "chunk int, ids binary, met binary, sums binary, moves binary")
    seen = np.zeros_like(arrays["m"])
    emb, flat = arrays["emb"].copy(), None
    for r in found.groupBy("chunk").applyInArrow(add, "chunk int, sums binary, moves binary").toLocalIterator():
        if r.chunk < 0:
            flat = np.frombuffer(bytes(r.sums), np.int64)
            continue
        for whole, part in ((seen, r.sums), (emb, r.moves)):
            own = np.frombuffer(bytes(part), np.float32).reshape(-1, whole.shape[1])[: len(whole) - r.chunk * CHUNK]
            whole[r.chunk * CHUNK :][: len(own)] += own
    shared.destroy()
    mean = np.split((flat[:-2] / STEPS / max(flat[-2], 1)).astype(np.float32), np.cumsum([arrays[n].size for n in Walk.FLAT])[:-1])
    arrays |= {n: arrays[n] + x.reshape(arrays[n].shape) for n, x in zip(Walk.FLAT, mean, strict=True)} | {"emb": emb, "tokens": int(flat[-1])}
    for n in Attention.NAMES:
        arrays.pop(f"squares_{n}", None)
    return maximised(seen)


def moved(arrays: dict[str, np.ndarray], slopes: np.ndarray, flat: np.ndarray, ids: float) -> dict[str, np.ndarray]:
    """The network, and the squares that steps are measured by, after one more adaptive
    step, against the mean gradient of ``ids`` ids."""
    sums = Learner.gradient(arrays, flat) | {"emb": slopes}
    out = {}
    for n, g in sums.items():
        g = (g / max(ids, 1)).astype(np.float32)
        out[f"squares_{n}"] = arrays[f"squares_{n}"] + g * g
        out[n] = arrays[n] - np.float32(RATE) * g / np.sqrt(out[f"squares_{n}"])
    return out


def maximised(seen: np.ndarray) -> np.ndarray:
    """Distributions from expected counts, with the ids' shares as prior; the last
    two ids (what stands before texts, and one to spare) have none.  Some rows at a
    time: the table is held once."""
    own = seen.sum(axis=0, dtype=np.float64)
    prior = seen @ np.ones(seen.shape[1], seen.dtype) + 0.02
    prior[-2:] = 0
    prior /= prior.sum(dtype=np.float64)
    out = np.empty(seen.shape, np.float32)
    for lo in range(0, len(seen), 4096):
        out[lo : lo + 4096] = (seen[lo : lo + 4096] + prior[lo : lo + 4096, None] * (0.02 * own + 1.0)) / (1.02 * own + 1.0)
    return out


def contexts(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, context keys, keys of context and word) of the words (the end of
    a text among them) that the memory covers: those whose two words before have
    a hash divisible by ``MEMORY``."""
    before = np.full(len(h), START_KEY)
    before[1:] = h[:-1]
    before[first[:-1]] = START_KEY
    second = np.full(len(h), START_KEY)
    second[2:] = h[:-2]
    second[first[:-1]] = START_KEY
    second[np.minimum(first[:-1] + 1, len(h) - 1)] = START_KEY
    key = mix(second * np.uint64(0x9E3779B97F4A7C15) + before)
    at = np.flatnonzero(key % np.uint64(MEMORY) == 0)
    key = key[at]
    return at, key & _KIND | np.uint64(1), mix(key * np.uint64(0xD6E8FEB86659FD93) + h[at]) & _KIND | np.uint64(2)


class Texts:
    """Hashes of the words of a part of a block (an end after each text): the
    keys that are counted, the last two bits of which say what they are of (0:
    word, 1: context, 2: word in its context)."""

    def __init__(self, part: pa.RecordBatch):
        buf, self.offsets = utf8(part.column(part.schema.get_field_index("text")))
        self.buf = lower(buf)
        starts, ends, first = words(self.buf, self.offsets)
        self.n = np.diff(first) + 1
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.hash = np.insert(span_hashes(self.buf, starts, ends), first[1:], END_KEY) & _KIND
        self.at, self.context, self.full = contexts(self.hash, self.first)
        self.keys = np.concatenate([self.hash, self.context, self.full])

    def weights(self, part: pa.RecordBatch) -> np.ndarray:
        """How often each of ``keys`` counts: as often as its row stands there, not where it is held out."""
        n = np.asarray(part.column(part.schema.get_field_index("_copies"))) * ~np.asarray(part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False), bool)
        n = np.repeat(n, self.n)
        return np.concatenate([n, n[self.at], n[self.at]])


def _parts(table: pa.Table):
    for batch in table.to_batches():
        yield from slices(batch, "text", PART_BYTES)


def _block_counts(block, parts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, of a block's parts (:class:`Texts` beside the
    rows that they are of), and their counts in training texts."""
    keys, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for texts, part in zip(block, parts, strict=True):
        k, at = np.unique(texts.keys, return_inverse=True)
        keys.append(k)
        n.append(np.bincount(at, texts.weights(part), len(k)).astype(np.int64))
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(n), len(keys)).astype(np.int64)


def _word_counts(buckets: int):
    """Per block: its distinct keys and their counts in training texts."""

    def run(table: pa.Table) -> pa.Table:
        keys, n = _block_counts(map(Texts, _parts(table)), _parts(table))
        bucket = ((keys >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, n, bucket = keys[order], n[order], bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(cut[1:], len(keys))
        return pa.table(
            {
                "bucket": pa.array(bucket[cut], pa.int32()),
                "block": pa.array(np.full(len(cut), table.column("block")[0].as_py()), pa.int32()),
                "keys": pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                "counts": pa.array([n[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
            }
        )

    return run


def _total_counts(table: pa.Table) -> pa.Table:
    """Per bucket: the corpus' counts of each block's keys, where they aren't the
    block's own; the number of the bucket's distinct training words stands in its first
    row."""
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    own = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")])
    every = np.concatenate(keys)
    known, at = np.unique(every, return_inverse=True)
    total = np.bincount(at, own, len(known)).astype(np.int64)
    word = known & np.uint64(3) == 0
    cut = np.cumsum([len(k) for k in keys])[:-1]
    every, found, own = np.split(every, cut), np.split(total[at], cut), np.split(own, cut)
    n = len(keys)
    once = lambda x: pa.array([int(x), *[0] * (n - 1)], pa.int64())
    return pa.table(
        {
            "block": table.column("block"),
            "keys": pa.array([k[t != o].tobytes() for k, t, o in zip(every, found, own, strict=True)], pa.binary()),
            "counts": pa.array([t[t != o].tobytes() for t, o in zip(found, own, strict=True)], pa.binary()),
            "distinct": once((total[word] > 0).sum()),
        }
    )


def score(docs: DataFrame, held_out: Column, tokenizer: str = TOKENIZER, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    network_score (what the network alone gives) of every row; ``held_out`` (over
    doc_id) says what isn't learned from."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    arrays = train(docs, ~held_out, tokenizer)
    tokens = arrays.pop("tokens", 0)
    blocks = block_count(spark, total, BLOCK_BYTES)
    rows = collapsed(rows).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    counted = rows.groupBy("block").applyInArrow(_word_counts(blocks), "bucket int, block int, keys binary, counts binary")
    answers = counted.groupBy("bucket").applyInArrow(_total_counts, "block int, keys binary, counts binary, distinct long")
    shared = spark.sparkContext.broadcast(arrays)  # 2 V rows of WIDTH and EXPERTS floats: fixed
    del arrays  # the driver needs them no more

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        one_thread()
        sub = subwords(tokenizer)
        scorer = Scorer(Attention(sub.end + 1, arrays=shared.value), sub.pad)
        # equal rows of several batches are one row, too
        texts = texts.group_by(["doc_id", "held_out", "text"], use_threads=False).aggregate([("_copies", "sum")]).rename_columns({"_copies_sum": "_copies"}).combine_chunks()
        # the block's words, found once: they are counted first and then scored
        block = [Texts(part) for part in _parts(texts)]
        keys, counts = _block_counts(block, _parts(texts))
        for k, n in zip(found.column("keys"), found.column("counts"), strict=True):
            counts[np.searchsorted(keys, np.frombuffer(k.as_py(), np.uint64))] = np.frombuffer(n.as_py(), np.int64)
        out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base_score", "score", "network_score")}
        for own in block:
            count = lambda h: counts[np.searchsorted(keys, h)].astype(np.float64)  # noqa: B023, E731
            c, cut = count(own.hash), own.first[:-1]
            base = np.log10(c + 0.1)
            ids, first, begin = sub.encode(own.buf, own.offsets)
            network = np.add.reduceat(np.log(np.maximum(scorer.probabilities(ids, first), 1e-30)), begin[:-1])
            p = mixed(network, c, tokens, share)
            p[own.at] = remembered(p[own.at], count(own.full), count(own.context))
            out["n_tokens"] += own.n.tolist()
            out["n_known"] += np.add.reduceat(c > 0, cut, dtype=np.int64).tolist()
            out["base_score"] += np.add.reduceat(base, cut).tolist()
            out["score"] += (np.add.reduceat(p, cut) / np.log(10)).tolist()
            out["network_score"] += (np.add.reduceat(network, cut) / np.log(10)).tolist()
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": texts.column("held_out"),
                "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                "n_known": pa.array(out["n_known"], pa.int64()),
                "train_tokens": pa.array([tokens] * len(texts), pa.int64()),
                "base_score": pa.array(out["base_score"], pa.float64()),
                "score": pa.array(out["score"], pa.float64()),
                "network_score": pa.array(out["network_score"], pa.float64()),
                "_copies": texts.column("_copies"),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, network_score double, _copies long"
    scored = rows.groupBy("block").cogroup(answers.select("block", "keys", "counts").groupBy("block")).applyInArrow(run, schema)
    # one number: the distinct training words of all buckets
    vocabulary = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"))
    scored = scored.crossJoin(F.broadcast(vocabulary))
    base = F.col("base_score") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.1 * (F.col("distinct") + 1))
    return expanded(scored.withColumn("base_score", base).drop("distinct"))


def mixed(network: np.ndarray, count: np.ndarray, tokens: int, share: float = SHARE) -> np.ndarray:
    """Log of the mixture of a word's corpus share and its subwords' probability."""
    rare = np.log1p(-share) + network
    known = np.log(share) + np.log(np.maximum(count, 0.5) / max(tokens, 1))
    return np.where(count > 0, np.logaddexp(rare, known), rare)


def remembered(p: np.ndarray, full: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Log probability of words in contexts that training texts hold ``context``
    times, ``full`` times with that word, given its log probability ``p`` without
    that memory."""
    return np.log((full + TRUST * np.exp(np.maximum(p, -700.0))) / (context + TRUST))


class Scorer:
    """The forward pass over whole texts.

    Each position's query, key, value (already through the output matrix and the
    hidden layer) and own part of the hidden layer come from one product with its
    embedding, once, though two windows hold it: window i of a text is its blocks
    i and i + 1 of ``SPAN`` positions."""

    def __init__(self, net: Attention, pad: int):
        p = self.p = net.p
        self.m, self.u, self.c, self.pad = p["m"], p["u"], p["c"], pad
        # tanh(z) is 1 - 2 / (exp(2 z) + 1): what goes into z comes doubled
        self.fold = np.float32(2) * (p["o"] @ p["w"])
        maps = np.concatenate([p["q"] * np.float32(WIDTH**-0.5), p["k"], p["v"], np.float32(2) * p["w"]], axis=1)
        self.table = p["emb"] @ maps
        self.table[:, 3 * WIDTH :] += np.float32(2) * p["b"]
        self.mask = p["bias"] + _MASK
        most = np.prod([np.sqrt((self.table[:, k : k + WIDTH] ** 2).sum(axis=1)).max() for k in (0, WIDTH)])
        self.steep = most + p["bias"].max() > 60  # else exp of the attention can't overflow
        self.bounded = (np.abs(p["u"]).sum(axis=0) + np.abs(p["c"])).max() <= 60  # then exp can't overflow, as tanh is in -1..1

    def lay(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets, place of each id among the targets) of the texts'
        blocks: a text of n windows has n + 1, the targets of the first are none."""
        size = np.diff(first)
        blocks = -(-size // SPAN) + 1
        begin = SPAN * (np.cumsum(blocks) - blocks)
        total = SPAN * int(blocks.sum())
        inputs, targets = np.full(total + SPAN + 1, self.pad, np.int32), np.full(total, self.pad, np.int32)
        place = np.arange(len(ids)) + np.repeat(begin - first[:-1] + SPAN, size)
        targets[place] = ids
        inputs[place + 1] = ids
        # a text's last id may fall behind its blocks, into the next text's
        inputs[begin] = self.pad
        return inputs[:total], targets, place

    def weights(self, inputs: np.ndarray) -> np.ndarray:
        """Weights of the distributions, not yet divided by their sum, at the
        targets of all blocks but the first."""
        return self._pass(inputs)[0]

    def _pass(self, inputs: np.ndarray):
        """The weights, and what the backward pass needs."""
        t = self.table[inputs]
        n, row, width = len(t) // SPAN - 1, t.strides[0], t.strides[1]
        # each window's two blocks, seen in place
        two = lambda lo, shape, strides: np.lib.stride_tricks.as_strided(t[:, lo:], (n, *shape), (SPAN * row, *strides))
        own = t[SPAN:].reshape(n, SPAN, -1)
        s = own[:, :, :WIDTH] @ two(WIDTH, (WIDTH, 2 * SPAN), (width, row))
        s += self.mask
        if self.steep:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        total = (s.reshape(-1, 2 * SPAN) @ np.ones(2 * SPAN, np.float32) + np.float32(1e-20)).reshape(n, SPAN, 1)
        av = s @ two(2 * WIDTH, (2 * SPAN, WIDTH), (row, width))
        av /= total
        g = av.reshape(-1, WIDTH) @ self.fold
        g += t[SPAN:, 3 * WIDTH :]
        np.minimum(g, 80, out=g)
        np.exp(g, out=g)
        g += 1
        np.divide(-2, g, out=g)
        g += 1
        logit = g @ self.u
        logit += self.c
        if not self.bounded:
            logit -= logit.max(axis=1, keepdims=True)
        return np.exp(logit, out=logit), t, own, two, s, total, av, g

    def steps(self, ids: np.ndarray, first: np.ndarray, batch: int = 128):
        """(targets, weights) of ``batch`` blocks at a time, in order."""
        inputs, targets, _ = self.lay(ids, first)
        for lo in range(SPAN, len(targets), SPAN * batch):
            hi = min(lo + SPAN * batch, len(targets))
            yield targets[lo:hi], self.weights(inputs[lo - SPAN : hi])

    def probabilities(self, ids: np.ndarray, first: np.ndarray, batch: int = 128) -> np.ndarray:
        """The probability of every id given those before it in its text."""
        if not len(ids):
            return np.zeros(0)
        one = np.ones(len(self.c), np.float32)
        out = [np.zeros(SPAN, np.float32)]
        for y, w in self.steps(ids, first, batch):
            out.append(np.einsum("nk,nk->n", w, self.m[y]) / (w @ one))
        return np.concatenate(out)[self.lay(ids, first)[2]].astype(np.float64)


class Learner(Scorer):
    """Sums over texts, with the network as it is: of the distributions' expected
    counts (``seen``), of the gradient of the embeddings (``slopes``) and of what the
    gradient of the other arrays follows from (``flat``)."""

    SHAPES = ((WIDTH, 3 * WIDTH + HIDDEN), (WIDTH, HIDDEN), (SPAN, 2 * SPAN), (HIDDEN,), (HIDDEN, EXPERTS), (EXPERTS,))

    def __init__(self, net: Attention, pad: int):
        super().__init__(net, pad)
        p = self.p
        self.maps = np.concatenate([p["q"] * np.float32(WIDTH**-0.5), p["k"], p["v"], p["w"]], axis=1)
        self.seen, self.slopes = np.zeros(p["m"].shape), np.zeros(p["emb"].shape)
        self.sums = [np.zeros(s) for s in self.SHAPES]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.sums])

    @classmethod
    def gradient(cls, p: dict[str, np.ndarray], flat: np.ndarray) -> dict[str, np.ndarray]:
        """The arrays' gradients but the embeddings', from sums of :meth:`flat`."""
        cuts = np.cumsum([np.prod(s) for s in cls.SHAPES])[:-1]
        maps, fold, bias, b, u, c = (x.reshape(s) for x, s in zip(np.split(flat, cuts), cls.SHAPES, strict=True))
        q, k, v, w = np.split(maps, [WIDTH, 2 * WIDTH, 3 * WIDTH], axis=1)
        return {"q": q * WIDTH**-0.5, "k": k, "v": v, "o": fold @ p["w"].T, "w": w + p["o"].T @ fold, "bias": bias, "b": b, "u": u, "c": c}

    def take(self, ids: np.ndarray, first: np.ndarray, batch: int = 128, copies: np.ndarray | None = None) -> None:
        """Adds the texts' sums; a text of ``copies`` counts so often."""
        inputs, targets, place = self.lay(ids, first)
        often = None
        if copies is not None and (copies > 1).any():
            often = np.zeros((len(targets), 1), np.float32)
            often[place, 0] = np.repeat(copies, np.diff(first))
        for lo in range(SPAN, len(targets), SPAN * batch):
            hi = min(lo + SPAN * batch, len(targets))
            self._sum(inputs[lo - SPAN : hi], targets[lo:hi], None if often is None else often[lo:hi])

    def _sum(self, inputs: np.ndarray, y: np.ndarray, often: np.ndarray | None = None) -> None:
        d, t, own, two, a, total, av, g = self._pass(inputs)
        n, one = len(own), np.ones(EXPERTS, np.float32)
        joint = self.m[y]
        joint *= d
        joint /= np.maximum(joint @ one, np.float32(1e-30))[:, None]
        d /= (d @ one)[:, None]
        d -= joint
        dead = y == self.pad
        d[dead] = 0
        if often is not None:
            d *= often
            joint *= often
        _add_rows(self.seen, y, joint)
        maps, fold, bias, b, u, c = self.sums
        u += g.T @ d
        c += np.ones(len(d), np.float32) @ d
        dz = d @ self.u.T
        g *= g
        np.subtract(1, g, out=g)
        dz *= g
        b += np.ones(len(dz), np.float32) @ dz
        av = av.reshape(-1, WIDTH)
        fold += av.T @ dz
        dav = dz @ (np.float32(0.5) * self.fold.T)
        through = np.einsum("nk,nk->n", dav, av).reshape(n, SPAN, 1)
        dav = dav.reshape(n, SPAN, WIDTH)
        a /= total
        dv = a.transpose(0, 2, 1) @ dav
        ds = dav @ two(2 * WIDTH, (WIDTH, 2 * SPAN), (t.strides[1], t.strides[0]))
        ds -= through
        ds *= a
        bias += (np.ones(n, np.float32) @ ds.reshape(n, -1)).reshape(bias.shape)
        dt = np.zeros_like(t)
        dt[SPAN:, :WIDTH] = (ds @ two(WIDTH, (2 * SPAN, WIDTH), t.strides)).reshape(-1, WIDTH)
        for lo, both in ((WIDTH, ds.transpose(0, 2, 1) @ own[:, :, :WIDTH]), (2 * WIDTH, dv)):
            dt[:-SPAN, lo : lo + WIDTH] = both[:, :SPAN].reshape(-1, WIDTH)
            dt[SPAN:, lo : lo + WIDTH] += both[:, SPAN:].reshape(-1, WIDTH)
        dt[SPAN:, 3 * WIDTH :] = dz
        maps += self.p["emb"][inputs].T @ dt
        _add_rows(self.slopes, inputs, dt @ self.maps.T)


class Walk:
    """A copy of the network that goes on over texts by small steps, and the expected
    counts that they have on the way.  Each step takes the embeddings of its own ids.
    After every ``RENEW`` steps the copy's distributions follow the counts, those of the
    start among them as so many of ``ANCHOR`` ids, which holds the copies together."""

    FLAT = tuple(n for n in Attention.NAMES if n != "emb")

    def __init__(self, arrays: dict[str, np.ndarray], pad: int):
        self.start, self.pad, self.ids, self.steps, self.m = arrays, pad, 0, 0, arrays["m"]
        self.now = {n: arrays[n] for n in self.FLAT} | {f"squares_{n}": arrays[f"squares_{n}"] for n in self.FLAT}
        self.emb, self.squares = arrays["emb"].copy(), arrays["squares_emb"].copy()
        self.seen, self.met = arrays["m"].astype(np.float64) * (ANCHOR / EXPERTS), np.zeros(len(arrays["m"]), np.int64)

    def take(self, ids: np.ndarray, first: np.ndarray, copies: np.ndarray) -> None:
        """Texts, in steps of about ``STEP_IDS`` ids; a text is in one step."""
        steps = max(1, round(len(ids) / STEP_IDS))
        cuts = np.unique(np.searchsorted(first, np.linspace(0, len(ids), steps + 1).astype(np.int64)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self._step(ids[first[a] : first[b]], first[a : b + 1] - first[a], copies[a:b])

    def _step(self, ids: np.ndarray, first: np.ndarray, copies: np.ndarray) -> None:
        used, at = np.unique(np.append(ids, self.pad), return_inverse=True)  # no id is greater than pad
        own = self.now | {"emb": self.emb[used], "squares_emb": self.squares[used], "m": self.m[used]}
        learner = Learner(Attention(len(used), arrays=own), len(used) - 1)
        learner.take(at[:-1].astype(np.int32), first, copies=copies)
        n = int(np.diff(first) @ copies)
        after = moved(own, learner.slopes, learner.flat(), n)
        self.emb[used], self.squares[used] = after.pop("emb"), after.pop("squares_emb")
        self.now = after
        self.ids += n
        learner.seen[-1] = 0  # what stands before texts is no target
        self.seen[used] += learner.seen
        self.steps += 1
        if self.steps % RENEW == 0:
            self.m = maximised(self.seen)
        self.met[used] += np.append(np.bincount(at[:-1], np.repeat(copies, np.diff(first)), len(used)).astype(np.int64)[:-1], n)

    def flat(self) -> np.ndarray:
        """The movement of all arrays but the embeddings, times the ids met."""
        return np.concatenate([(self.now[n] - self.start[n]).ravel() for n in self.FLAT]).astype(np.float64) * self.ids

    def counts(self, own: np.ndarray) -> np.ndarray:
        """The ids' expected counts in the texts."""
        return self.seen[own] - self.start["m"][own].astype(np.float64) * (ANCHOR / EXPERTS)

    def moves(self, own: np.ndarray) -> np.ndarray:
        """The movement of the ids' embeddings, times how often each was met."""
        return (self.emb[own] - self.start["emb"][own]).astype(np.float64) * self.met[own, None]


def _add_rows(to: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of ``values`` to the row of ``to`` that ``at`` names."""
    order = np.argsort(at)
    at = at[order]
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[head]] += np.add.reduceat(values[order], head, axis=0)


def score_ids(net: Attention, ids: np.ndarray, first: np.ndarray, pad: int, batch: int = 128) -> np.ndarray:
    return Scorer(net, pad).probabilities(ids, first, batch)
