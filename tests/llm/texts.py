"""Small tables with nulls, empty and long texts, repeats and clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, key string"


def documents(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, g, "src0", len(t or ""), "x", None) for i, t, g in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


ODD_TEXTS = [
    None,
    "",
    " ",
    "Hello world, it's a test.  Two  spaces\n\n\tand tabs ",
    "don't we'll they've <|endoftext|> inside<|endoftext|><|endoftext|>",
    "naïve café — “quotes” … 日本語 テスト 🙂🙂 ½ ² x² 1²3 é",
    "a b c d\x1ce\x85f\x0bg\r\nh",
    "x" * 5000,
    "word " * 60000,
    "   leading and trailing   ",
    "mixed123numbers 4567 ___ __init__ $$$ !!! ?!",
    "same text",
    "same text",
    "İstanbul ǅ ʼn ﬁ Ⅷ ٣٤ देवनागरी",
]
