"""Operator 9: token counts by batch encoding in Arrow functions.

Only lengths leave Python.  Batches are cut by bytes, a long text is cut at
safe boundaries, and within a batch each distinct pre-token is encoded once by
the library's own batch call; a bounded memo carries lengths from batch to
batch.

Nulls and empty texts have 0 bytes and 0 tokens.  Rows with the same id or text
each keep a row of their own.  Further columns are ignored, clashing names
included; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices
from .vocab import bpe, pretokens, vocabulary_path

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 18
MEMO_WORDS = 300_000
#: Before a single space between a non-space and an ASCII letter: whatever stands left of it is split the same without what stands right.
_SAFE = re.compile(r"(?<=[0-9A-Za-z.,;:!?])(?= [A-Za-z])")


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """The text, cut at safe boundaries into pieces of about ``limit``
    characters (more only where there is no such boundary)."""
    at = 0
    while len(text) - at > limit and (m := _SAFE.search(text, at + limit)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class JsonLengths:
    """Token counts as the tokenizers library gives them for a .json file."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.byte_level = '"ByteLevel"' in str(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer else False
        self.special = bpe(name).split_special if self.byte_level else None
        self.memo: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.byte_level:  # pre-tokens of other kinds: the library takes whole texts
            return self._encode(texts)
        out, memo = [0] * len(texts), self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        split: list[tuple[int, list[str]]] = []
        unseen: set[str] = set()
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            out[i] += len(parts) // 2  # each special string is one token
            for part in parts[::2]:
                for piece in pieces(part):
                    split.append((i, words := pretokens(piece)))
                    unseen.update(w for w in words if w not in memo)
        if unseen:
            new = list(unseen)
            memo.update(zip(new, self._encode(new), strict=True))
        for i, words in split:
            out[i] += sum(map(memo.__getitem__, words))
        return out


class PieceLengths:
    """Token counts as the sentencepiece library gives them for a .model file."""

    def __init__(self, name: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]


@lru_cache(2)
def lengths(name: str):
    return JsonLengths(name) if name.endswith(".json") else PieceLengths(name)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit."""

    def count(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        engine = lengths(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n = engine.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(np.asarray(n, np.int64) > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
