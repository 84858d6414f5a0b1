import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from formlens.llm import pii
from formlens.llm.vocabularies import WORD_VOCABULARY, Memory, WordIds


def held_bytes(memory):
    return sum(sys.getsizeof(key) + sys.getsizeof(value) for part in (memory, memory.older) for key, value in part.items())


def test_memory_is_bounded_by_bytes_and_forgets_no_value_it_is_asked_for():
    memory = Memory(lambda key: bytes(len(key)), 1_000_000, max_bytes=1 << 20)
    for k in range(100_000):
        key = f"{k:06d}" * 50
        assert memory[key] == bytes(300)
    assert held_bytes(memory) <= (2 << 20) + 1_000
    memory["x" * (8 << 20)]
    assert held_bytes(memory) <= 2 << 20


def test_ids_of_long_unspaced_paragraphs_take_bounded_memory():
    ids, plain = WordIds(WORD_VOCABULARY), WordIds(WORD_VOCABULARY)
    ids.pieces.max_bytes = 1 << 18
    rng = random.Random(4)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)) for _ in range(400)] + ["plain words " * 20]
    assert ids.encode(pa.array(texts)) == plain.encode(pa.array(texts))
    assert held_bytes(ids.pieces) <= (2 << 18) + 8_192


@pytest.mark.parametrize("sizes", [[], [0, 0], [5, 1000, 0, 3, 3, 999], [2000]])
def test_slices_hold_every_row_once_in_order(monkeypatch, sizes):
    monkeypatch.setattr(pii, "SLICE_BYTES", 10)
    texts = [None if n == 0 else "é" * n for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(pii._slices(batch))
    assert [row for part in parts for row in part.column(0).to_pylist()] == list(range(len(sizes)))
    assert all(part.num_rows for part in parts)


def test_messages_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(2)
    numbers = [str(rng.randrange(10**9, 10**10)) for _ in range(20)]
    texts = [" ".join(rng.choice(numbers) for _ in range(200)) + " call +49 170 765 43 21 or 170 765 43 21" for _ in range(3)]
    field = pii.SkipChainField()
    field.fit(pii.build_graph(texts, [pii.base_spans(text) for text in texts]), rounds=30)
    graph = pii.build_graph(texts, [pii.base_spans(text) for text in texts])
    whole = field.chances(graph)
    monkeypatch.setattr(pii, "BLOCK_LINKS", 7)
    assert np.allclose(field.chances(graph), whole, atol=1e-12)
