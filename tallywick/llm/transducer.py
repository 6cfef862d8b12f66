"""Operator 5: BPE encoding and decoding through a transducer lexicon.

Frequent words of the corpus are compiled with their ids into a minimal acyclic
automaton (sorted insertion; equal suffix states are shared through a register)
whose outputs sit on the transitions: each word's number is the sum of the
numbers on its path, and the number addresses its ids.  The arrays go to the
tasks as one bounded broadcast and are memory-mapped there.  Words outside the
lexicon are merged exactly.

Nulls and empty texts give no ids; special strings inside texts are their own
id, as the library's default has it; rows with the same id or text each keep a
row of their own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices
from .token_counts import pieces
from .vocab import bpe, pretokens

#: Words in the lexicon at most (its size bounds the broadcast); a word counts in a split where it stands this often.
LEXICON_WORDS = 30_000
SPLIT_MINIMUM = 20
MEMO_WORDS = 300_000


class Lexicon:
    """A minimal acyclic transducer as flat arrays.

    State s has transitions first[s]..first[s+1]-1, each with a byte, a target
    and the number of words of the state's language before it; final[s] says
    whether a word ends there.  A word's number selects its ids."""

    def __init__(self, blob: bytes | mmap.mmap):
        head = np.frombuffer(blob, np.int64, 5)
        at, parts = 40, []
        for kind, n in zip((np.int32, np.uint8, np.int32, np.int32, np.uint8, np.int32, np.int32), (head[0] + 1, head[1], head[1], head[1], head[0], head[2] + 1, head[3]), strict=True):
            parts.append(np.frombuffer(blob, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        self.first, self.byte, self.target, self.before, self.final, self.span, self.ids = parts
        self.root = int(head[4])

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> bytes:
        """Sorted insertion with a register of finished states."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []
        path: list[list] = [[False, []]]  # open states of the last word: [final, [(byte, state)]]

        def close(depth: int, last: bytes) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][1].append((last[len(path) - 1], register[key]))

        last = b""
        for word in sorted(entries):
            common = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
            close(common, last)
            path.extend([False, []] for _ in range(len(word) - common))
            path[-1][0] = True
            last = word
        close(0, last)
        states.append((path[0][0], tuple(path[0][1])))
        count: list[int] = []
        first, byte, target, before, final = [0], [], [], [], []
        for is_final, edges in states:  # targets come before their sources
            n = int(is_final)
            for b, to in edges:
                byte.append(b)
                target.append(to)
                before.append(n)
                n += count[to]
            first.append(len(byte))
            final.append(is_final)
            count.append(n)
        words = sorted(entries)
        span = np.concatenate([[0], np.cumsum([len(entries[w]) for w in words])]) if words else np.zeros(1)
        flat = [i for w in words for i in entries[w]]
        out = [np.array([len(states), len(byte), len(words), len(flat), len(states) - 1], np.int64).tobytes()]
        for kind, values in ((np.int32, first), (np.uint8, byte), (np.int32, target), (np.int32, before), (np.uint8, final), (np.int32, span), (np.int32, flat)):
            raw = np.asarray(values).astype(kind).tobytes()
            out.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(out)

    def lookup(self, words: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each word, None if the automaton doesn't accept it; all words
        step through the automaton together, a byte at a time."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(b"".join(words), np.uint8)
        source = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
        key = source * 256 + self.byte
        state = np.full(n, self.root, np.int64)
        number = np.zeros(n, np.int64)
        live = np.arange(n)
        for step in range(int(sizes.max(initial=0))):
            live = live[sizes[live] > step]
            if not len(live) or not len(key):
                state[live] = -1
                break
            want = state[live] * 256 + flat[starts[live] + step]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            found = key[at] == want
            state[live[~found]] = -1
            live, at = live[found], at[found]
            number[live] += self.before[at]
            state[live] = self.target[at]
        ok = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return [self.ids[self.span[k] : self.span[k + 1]] if good else None for good, k in zip(ok, number, strict=True)]


def frequent_words(docs: DataFrame, text_col: str = "text", size: int = LEXICON_WORDS, minimum: int = SPLIT_MINIMUM) -> list[str]:
    """The corpus' most frequent words between white space, counted in every
    split over whole texts and summed; at most ``size`` reach the driver.  They
    only decide what is compiled ahead, never an id."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update((text.as_py() or "").split())
        kept = [(w, n) for w, n in seen.items() if n >= minimum and len(w) < 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in top.collect()]


def compile_lexicon(words: list[str], tokenizer: str) -> bytes:
    """Each word as it stands and after a space, split into pre-tokens."""
    model = bpe(tokenizer)
    entries = {p.encode() for w in words for form in (w, " " + w) for p in pretokens(form)}
    return Lexicon.compile({e: model.merge(e) for e in entries})


@lru_cache(2)
def _mapped(key: str, blob) -> Lexicon:
    with tempfile.TemporaryFile() as f:  # has no name, so nothing is left behind
        f.write(blob.value)
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Encoder:
    def __init__(self, lexicon: Lexicon, tokenizer: str):
        self.lexicon, self.model, self.memo = lexicon, bpe(tokenizer), {}
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in self.model.special.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        split: list[list] = []
        unseen: set[str] = set()
        for text in texts:
            parts = self.model.split_special.split(text) if self.model.split_special else [text]
            row: list = []
            for k, part in enumerate(parts):
                if k % 2:
                    row.append(part)
                    continue
                for piece in pieces(part):
                    row.append(words := pretokens(piece))
                    unseen.update(w for w in words if w not in memo)
            split.append(row)
        if unseen:
            new = list(unseen)
            raw = [w.encode() for w in new]
            for w, r, ids in zip(new, raw, self.lexicon.lookup(raw), strict=True):
                memo[w] = (np.array(self.model.merge(r), "<u4") if ids is None else ids.astype("<u4")).tobytes()
        get = memo.__getitem__
        return [b"".join(self.special[x] if isinstance(x, str) else b"".join(map(get, x)) for x in row) for row in split]

    def decode(self, ids: bytes) -> str:
        get = self.model.token_bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary, little-endian unsigned
    32-bit), n_tokens and decoded (the text read back from the ids)."""
    return _mapped_rows(docs, tokenizer, id_col, text_col, lexicon_words, "doc_id long, n_tokens long, ids binary, decoded string", _full)


def encode_digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """:func:`encode_decode` with digests in place of ids and decoded text."""
    return _mapped_rows(docs, tokenizer, id_col, text_col, lexicon_words, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _full(ids: list[bytes], decoded: list[str]):
    return [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]


def _digests(ids: list[bytes], decoded: list[str]):
    return [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]


def _mapped_rows(docs, tokenizer, id_col, text_col, lexicon_words, schema, last) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    compiled = compile_lexicon(frequent_words(docs, text_col, lexicon_words), tokenizer)
    key, blob = hashlib.sha256(compiled).hexdigest(), sc.broadcast(compiled)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        encoder = Encoder(_mapped(key, blob), tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, *last(ids, [encoder.decode(x) for x in ids])], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
