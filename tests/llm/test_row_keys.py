"""Decontamination drops rows, whatever their ids (near-dedup: test_near_texts)."""

from tallywick.llm import decontaminate

from .texts import documents


def test_keep_clean_with_null_and_shared_ids(spark):
    item, clean = "some long item of a benchmark", "nothing of that kind stands here"
    docs = documents(spark, [item, clean, item, clean, None], [None, None, 3, 3, None])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = [(r.doc_id, r.text) for r in decontaminate.keep_clean(docs, items).collect()]
    assert sorted(kept, key=str) == sorted([(None, clean), (3, clean), (None, None)], key=str)
