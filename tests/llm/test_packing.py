import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from formlens.llm.differencing import balanced_windows, fitting_windows
from formlens.llm.packing import pack_documents
from formlens.llm.vocabularies import WORD_VOCABULARY, load

TEXTS = [
    None, "", "  ", "don't WE'LL it's 's ''s É'D x'sy", "<|endoftext|> and <|startoftext|>x", "naïve “quotes” 한국어 Σας İ",
    "ab\x1dcd \u0085 x\xa0y", "12 345² ½", "long " * 30_000, "don't WE'LL it's 's ''s É'D x'sy",
]


def ids_of(text):
    return np.array(load(WORD_VOCABULARY).encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def check(rows, pieces, capacity):
    """Every id in one piece, windows gapless and not over capacity."""
    by_window = {}
    for p in pieces:
        by_window.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for placed in by_window.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    by_text = {}
    for p in pieces:
        by_text.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    wanted = {}
    for doc_id, text in rows:
        ids = ids_of(text)
        wanted.setdefault((doc_id, len(ids)), []).append(ids)
    assert by_text.keys() == wanted.keys()
    for key, texts in wanted.items():
        assert sum(length for _, length, _ in by_text[key]) == sum(map(len, texts))
        for start, length, crc in by_text[key]:
            assert any(zlib.crc32(ids[start : start + length].tobytes()) == crc for ids in texts)
    return len(by_window)


def test_odd_texts(spark):
    rows = [(k if k != 4 else None, text) for k, text in enumerate(TEXTS)] + [(0, None)]
    docs = spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, offset int").repartition(2)
    check(rows, pack_documents(docs).collect(), 2048)
    assert pack_documents(docs.limit(0)).count() == 0


def test_shared_documents_fill_their_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(row) for row in docs.collect()]
    pieces = pack_documents(docs).collect()
    n_windows = check(rows, pieces, 2048)
    assert sum(p.length for p in pieces) > 0.98 * 2048 * n_windows


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_windows_fit(lengths):
    lengths = np.array(lengths)
    window, n_windows = fitting_windows(lengths, 40)
    assert np.bincount(window, weights=lengths, minlength=n_windows).max() <= 40
    assert n_windows >= -(-lengths.sum() // 40)


def test_windows_are_nearly_equal():
    lengths = np.random.default_rng(0).integers(1, 500, 2000)
    sums = np.bincount(balanced_windows(lengths, 100), weights=lengths)
    assert sums.max() - sums.min() <= 5
