"""Byte-level BPE vocabulary: files, pre-token patterns and exact merges.

The vocabulary file is a parameter and never copied; it is read where the task
runs, by the path that the tokenizers package reports there.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: The pre-token pattern and byte alphabet of this vocabulary format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of plain characters only, where ``re`` is faster.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters for which both patterns agree: ASCII and Latin-1 letters.
_ODD = re.compile("[^\t\n\v\f\r\x20-\x7e\xc0-\xff]")


@lru_cache(4)
def vocabulary_path(name: str) -> str:
    """``name`` itself if it is a path, else the installed file of that name."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _patterns():
    import regex

    return re.compile(PLAIN_PATTERN).findall, regex.compile(PATTERN).findall


def pretokens(text: str) -> list[str]:
    plain, full = _patterns()
    return full(text) if _ODD.search(text) else plain(text)


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Bpe:
    """Ids, token bytes and exact merges of a byte-level BPE file."""

    def __init__(self, name: str):
        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = raw(token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for token, i in vocab.items():
            if len(token) == 1:
                self.byte_id[alphabet[token]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank, leftmost first, until
        none is left."""
        ids = [self.byte_id[b] for b in piece]
        if len(ids) > 400:
            return self._merge_long(ids)
        get = self.merges.get
        while len(ids) > 1:
            best, where, new = 1 << 60, -1, 0
            for k in range(len(ids) - 1):
                m = get((ids[k], ids[k + 1]))
                if m is not None and m[0] < best:
                    best, where, new = m[0], k, m[1]
            if where < 0:
                break
            ids[where : where + 2] = [new]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for pre-tokens of any length."""
        from heapq import heapify, heappop, heappush

        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapify(heap)
        while heap:
            _, k, a, b, new = heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left in (before[k], k):
                if left >= 0 and (right := after[left]) >= 0 and (m := get((ids[left], ids[right]))):
                    heappush(heap, (m[0], left, ids[left], ids[right], m[1]))
        return [i for i in ids if i >= 0]


@lru_cache(2)
def bpe(name: str) -> Bpe:
    return Bpe(name)
