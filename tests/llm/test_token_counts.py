from formlens.llm.token_counts import count_tokens
from formlens.llm.vocabularies import BYTE_VOCABULARY, load

TEXTS = [
    None, "", " ", "don't  stop\n\n now ", "<|endoftext|>a<|endoftext|>", "naïve “quoted” 한국어 Σας", "tab\tx\x1cy  ",
    "12 345²", "word " * 3000, "don't  stop\n\n now ", "\u0085x\xa0y", "'s's", "  lead", "trail  ",
]


def expected(text):
    return len(load(BYTE_VOCABULARY).encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark):
    rows = [(i if i != 3 else None, text, "x") for i, text in enumerate(TEXTS)] + [(1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for frequent in (0, 5, 1000):
        got = [tuple(row) for row in count_tokens(docs, frequent=frequent).collect()]
        want = [(i, len((t or "").encode()), expected(t), expected(t) > 1024) for i, t, _ in rows]
        key = lambda row: (row[0] is None, row[0] or 0, row[1])
        assert sorted(got, key=key) == sorted(want, key=key)


def test_shared_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {(r.doc_id, len(r.text.encode()), expected(r.text)) for r in docs.collect()}
    assert {tuple(r)[:3] for r in count_tokens(docs, frequent=500).collect()} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(docs).collect() == []
