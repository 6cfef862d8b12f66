"""The pipeline against its stages' plain rules on a small corpus."""

import numpy as np
import pandas as pd

import corpus_pipeline
from tallywick.llm import shared
from tallywick.llm.vocab import vocabulary_path

from .test_near_texts import classes


def test_stages_and_run(spark, tmp_path):
    rng = np.random.default_rng(0)
    vocab = ["".join(rng.choice("an er th in ed ti on re st wh".split(), rng.integers(1, 4))) for _ in range(800)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    texts = [text(rng.integers(20, 120)) for _ in range(400)]
    bad = {i for i in range(400) if i % 4 == 0}
    for i in bad:
        texts[i] = " ".join(w + "&&&" for w in texts[i].split())
    passage, item = text(60), text(30)
    for i in (1, 5, 9):
        texts[i] += " " + passage
    copies = [400, 401, 402]
    texts += [texts[2]] + [texts[3]] * 2 + [text(10) + " " + item + " " + text(10), None, ""]
    n = len(texts)
    docs = pd.DataFrame({"doc_id": range(n), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t or "") for t in texts]})
    labels = pd.DataFrame({"doc_id": range(400), "quality": [int(i not in bad) for i in range(400)], "toxic": 0})
    for name, pdf in (("documents", docs), ("labels", labels), ("benchmark", pd.DataFrame({"item_id": [7], "text": [item]}))):
        pdf.to_parquet(tmp_path / f"{name}.parquet", index=False)
    sf_dir = str(tmp_path)
    now, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_dir).toPandas()
        kept.append(out.set_index("doc_id").sort_index())
        assert out.doc_id.is_unique
        if stage is not corpus_pipeline.encoding:
            assert list(out.columns) == list(corpus_pipeline.COLUMNS)
            out.to_parquet(tmp_path / f"stage{len(kept)}.parquet", index=False)
            now = spark.read.parquet(f"{sf_dir}/stage{len(kept)}.parquet")
    good, near, exact, clean, coded = kept
    assert not bad & set(good.index) and set(range(400)) - bad <= set(good.index)
    ids = list(good.index)
    roots = classes([good.text[i] for i in ids])
    assert list(near.index) == sorted({ids[r] for r in roots})
    assert not set(copies) & set(near.index)
    assert list(exact.index) == list(near.index)
    assert not any(passage in t for t in exact.text) and (exact.n_chars == exact.text.str.len()).all()
    same = [i for i in exact.index if i not in (1, 5, 9)]
    assert (exact.text[same] == near.text[same].fillna("")).all()
    leaked = {i for i in exact.index if item in exact.text[i]}
    assert leaked and list(clean.index) == [i for i in exact.index if i not in leaked]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for i in coded.index:
        assert np.frombuffer(coded.ids[i], "<u4").tolist() == library.encode(clean.text[i], add_special_tokens=False).ids
        assert coded.decoded[i] == clean.text[i]
    before = shared.written_so_far()
    ran = corpus_pipeline.run(spark, sf_dir)
    assert shared.written_so_far() == before + 1  # nothing is left behind but the result
    whole = ran.toPandas().set_index("doc_id").sort_index()
    assert whole.equals(coded)


def test_empty_tables_missing_ids_and_long_texts(spark, tmp_path):
    good = "plain words that stand in a row and mean nothing at all to anyone who reads them"
    long = " ".join(f"w{k}" for k in range(150_000))
    rows = [(1, good, "en", "s", 1), (None, good, "en", "s", 1), (None, None, None, None, None), (2, long, "en", "s", 9), (2, long, "en", "s", 9), (2, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, docs in (("some", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        assert sorted((str(r.doc_id), r.decoded) for r in got) == ([] if not docs else sorted([("1", good), ("2", long), ("2", "")]))
