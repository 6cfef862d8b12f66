import hashlib

import numpy as np
import pytest

from tallywick.llm import token_counts, transducer
from tallywick.llm.vocab import bpe, pretokens, vocabulary_path

from .texts import ODD_TEXTS, documents

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(NAME))


def test_merges_equal_the_library(library):
    rng = np.random.default_rng(3)
    alphabet = list("abcdefgh  \n.,'12é日🙂sST")
    for _ in range(400):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        ids = [i for w in pretokens(text) for i in bpe(NAME).merge(w.encode())]
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("ab" * 900, "the" * 700, " " * 1000, "é" * 600):
        assert [i for w in pretokens(text) for i in bpe(NAME).merge(w.encode())] == library.encode(text, add_special_tokens=False).ids


def test_counts_equal_the_library(spark, library):
    got = {r.doc_id: r for r in token_counts.token_counts(documents(spark, ODD_TEXTS)).collect()}
    assert len(got) == len(ODD_TEXTS)
    for i, text in enumerate(ODD_TEXTS):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 512), repr(text)[:60]


def test_counts_of_a_sentencepiece_model(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark, ODD_TEXTS[:7]), "piece_bpe_32k.model").collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in enumerate(ODD_TEXTS[:7])}


def test_long_texts_are_cut_only_where_tokens_end(library):
    text = "some words, more words. And 12 more; it's " * 50
    parts = list(token_counts.pieces(text, 64))
    assert len(parts) > 10 and "".join(parts) == text
    assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_equal_the_library(spark, library):
    docs = documents(spark, ODD_TEXTS)
    got = {r.doc_id: r for r in transducer.encode_digests(docs).collect()}
    full = {r.doc_id: r for r in transducer.encode_decode(docs).collect()}
    for i, text in enumerate(ODD_TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert bytes(full[i].ids) == raw and full[i].decoded == decoded, repr(text)[:60]
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_lexicon_is_minimal_and_exact():
    words = [a + b for a in ("walk", "talk", "work") for b in ("", "s", "ed", "ing")]
    entries = {w.encode(): [k, k + 1] for k, w in enumerate(words)}
    lexicon = transducer.Lexicon(transducer.Lexicon.compile(entries))
    for w, found in zip(entries, lexicon.lookup(list(entries)), strict=True):
        assert found.tolist() == entries[w]
    assert lexicon.lookup([b"wal", b"walks!", b"x", b""]) == [None] * 4
    rights = {tuple(sorted(w[len(p) :] for w in entries if w.startswith(p))) for w in entries for p in (w[:k] for k in range(len(w) + 1))}
    assert len(lexicon.first) - 1 == len(rights)  # one state per distinct set of continuations
    empty = transducer.Lexicon(transducer.Lexicon.compile({}))
    assert empty.lookup([b"a"]) == [None]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert token_counts.token_counts(docs).collect() == []
    assert transducer.encode_digests(docs).collect() == []
