import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tallywick.llm import alignment
from tallywick.llm.vocab import bpe, vocabulary_path

from .texts import ODD_TEXTS, documents


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path(alignment.A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(alignment.B_FILE))
    return a, b


def groups_of(sides, text):
    """Groups of a text by the libraries on the whole text; None: no tokens."""
    a, b = sides
    if not text:
        return None
    raw = (" " + text).encode()
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    xb = [bpe(alignment.A_FILE).token_bytes[i] for i in x]
    yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if b"".join(xb) != raw or b"".join(yb) != raw:
        return None
    xe, ye = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
    out, i, j = [], 0, 0
    for cut in sorted(set(xe) & set(ye)):
        p, q = xe.index(cut, i) + 1, ye.index(cut, j) + 1
        out.append((x[i:p], y[j:q]))
        i, j = p, q
    return out


def brute(sides, texts):
    groups = [groups_of(sides, t) for t in texts]
    holds = defaultdict(set)
    for k, gs in enumerate(groups):
        for x, y in gs or []:
            for a in set(x):
                for b in set(y):
                    holds[a, b].add(k)
    best = defaultdict(int)
    for (a, _), docs in holds.items():
        best[a] = max(best[a], len(docs))
    for k, gs in enumerate(groups):
        if gs is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        found = [len(holds[a, b]) - (0 if len(holds[a, b]) < best[a] else 0.5) for x, y in gs for a in x for b in y]
        sha = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs).encode()).hexdigest()
        n_best = sum(f % 1 == 0.5 for f in found)
        yield (sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(found), n_best, int(sum(found) + 0.5 * n_best), sha)


def got(frame):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect()}


ODD = [
    *ODD_TEXTS[:8],
    "word " * 300,
    *ODD_TEXTS[9:],
    "a▁b",
    "▁",
    "x",
    " x",
    "x ",
    "tab\t x\n  y\n\n  z   w　 v",
    "a\x1c b\x85 c",
    "<s>x</s> <0x41> <unk>",
    "\U0001f642\U0001f642" * 40,
    "d\u0000e",
]


def test_rows_equal_brute_force(spark, sides):
    rng = np.random.default_rng(5)
    alphabet = list("abcde    \n\t.,'12é日🙂▁<>s/|")
    texts = [*ODD, *("".join(rng.choice(alphabet, rng.integers(0, 50))) for _ in range(150))]
    texts += ["the quick brown fox, unbelievably antidisestablishmentarian"] * 20
    assert got(alignment.align(documents(spark, texts).repartition(3))) == dict(enumerate(brute(sides, texts)))


def test_units_are_encoded_as_whole_texts_are(sides):
    rng = np.random.default_rng(8)
    known = alignment.Units(alignment.A_FILE, alignment.B_FILE)
    for k in range(300):
        text = "".join(rng.choice(list("ab  \n\t\r\x0b   .'é日�▁" if k % 2 else "abc  .'s12"), rng.integers(1, 60)))
        columns, _ = known.block([text])
        want = groups_of(sides, text)
        sha = "" if want is None else hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want).encode()).hexdigest()
        assert columns[4] == [sha], repr(text)


def test_hot_stripes_go_in_pieces_and_long_texts_in_segments(spark, sides, monkeypatch):
    texts = ["one two, three! four-five " * 12, "two one", "three", "x" * 900, None] * 4
    want = dict(enumerate(brute(sides, texts)))
    for name, value in (("PIECE_PAIRS", 8), ("SEGMENT_CHARS", 16), ("BLOCK_BYTES", 64), ("EXPAND", 4), ("PARTIAL_PAIRS", 16)):
        monkeypatch.setattr(alignment, name, value)
    known = alignment.Units(alignment.A_FILE, alignment.B_FILE)
    columns, _ = known.block([t or "" for t in texts])
    assert [list(map(int, c)) for c in columns[:4]] == [[want[i][c] for i in range(len(texts))] for c in range(4)]
    assert columns[4] == [want[i][6] for i in range(len(texts))]
    assert "".join(s + " " for s in alignment.segments(texts[0], 16)) == texts[0] + " "
    assert got(alignment.align(documents(spark, texts).repartition(4))) == want


def test_pair_counts(spark, sides):
    texts = ["alpha beta", "alpha beta", "alpha", None]
    linked = alignment.links(documents(spark, texts))
    rows = alignment.pair_counts(alignment.count_matrices(linked)).collect()
    want = defaultdict(set)
    for k, t in enumerate(texts):
        for x, y in groups_of(sides, t) or []:
            for a in x:
                for b in y:
                    want[a, b].add(k)
    assert {(r.a_id, r.b_id): r.n_docs for r in rows} == {p: len(v) for p, v in want.items()}
    best = defaultdict(int)
    for r in rows:
        best[r.a_id] = max(best[r.a_id], r.n_docs)
    assert all(r.best == (r.n_docs == best[r.a_id]) for r in rows)


def test_null_and_repeated_ids(spark, sides):
    texts = ["same words", "same words", "other", "same words"]
    rows = alignment.align(documents(spark, texts, ids=[None, 7, 7, None])).collect()
    want = list(brute(sides, texts))
    assert sorted((str(r.doc_id), r.n_a, r.n_best, r.count_sum) for r in rows) == sorted((str(i), w[0], w[4], w[5]) for i, w in zip([None, 7, 7, None], want, strict=True))


def test_empty_tables(spark):
    assert alignment.align(documents(spark, [])).collect() == []
    assert got(alignment.align(documents(spark, [None, ""]))) == {i: (0, 0, 0, 0, 0, 0, "") for i in range(2)}


def test_a_task_forgets_units_and_learns_them_again(sides, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, 40) % 500) for _ in range(60)]
    plain = alignment.Units(alignment.A_FILE, alignment.B_FILE)
    want = [plain.block(texts[k : k + 3]) for k in range(0, 60, 3)]
    monkeypatch.setattr(alignment, "MEMO_UNITS", 60)
    small = alignment.Units(alignment.A_FILE, alignment.B_FILE)
    sizes = []
    for k, (columns, found) in zip(range(0, 60, 3), want, strict=True):
        got, links = small.block(texts[k : k + 3])
        assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip([*got, *links], [*columns, *found], strict=True))
        sizes.append(len(small.index))
    assert min(b - a for a, b in zip(sizes, sizes[1:])) < 0 and max(sizes) < len(plain.index)
