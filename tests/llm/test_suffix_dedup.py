import hashlib
import random

import numpy as np
import pytest

from formlens.llm import suffix_dedup
from formlens.llm.suffix_dedup import merged, remove_repeats


def by_force(rows, length=100):
    """Kept bytes and removed runs of rows ``(doc_id, text)`` in documents' order."""
    seen, out = {}, {}
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for start in range(len(data) - length + 1):
            string = data[start : start + length]
            if seen.setdefault(string, (doc_id, start)) != (doc_id, start):
                gone[start : start + length] = True
        runs, kept = [], bytes(np.frombuffer(data, np.uint8)[~gone])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out[doc_id] = (runs, kept)
    return out


def prose(rng, n):
    return "".join(rng.choice("abcdeé \n") for _ in range(n))


def found_of(frame):
    return {row["doc_id"]: ([(r["start"], r["stop"]) for r in row["removed"]], bytes(row["kept"])) for row in remove_repeats(frame).collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (30, 60, 99, 100, 101, 150, 400, 900)]
    rows = []
    for doc_id in range(150):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else prose(rng, rng.choice([1, 5, 40, 200])) for _ in range(rng.randrange(7)))
        if rng.random() < 0.3 and rows:
            base = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(3)):
                if base:
                    base[rng.randrange(len(base))] = "X"
            text = "".join(base)
        rows.append((doc_id, text))
    rows += [(200, "ab" * 300), (201, "a" * 1000), (202, "ab" * 300), (203, ""), (204, "a" * 99), (205, passages[6][:-1]), (206, "xa" + "ab" * 200 + "b")]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(7)
    assert found_of(frame) == by_force(rows)


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 700)
    rng = random.Random(8)
    common = prose(rng, 5000)
    rows = [(0, prose(rng, 300) + common), (1, common[100:] + prose(rng, 3000)), (2, prose(rng, 50) + common[40:3000] + common[10:900])]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert found_of(frame) == by_force(rows)


def test_nulls_copies_and_columns(spark):
    text = prose(random.Random(1), 250).replace("é", "e")
    rows = [(None, text, 1, b"r"), (4, text, 2, b"r"), (4, text, 2, b"r"), (4, text[:120], 3, b"r"), (5, None, 4, b"r"), (6, "", 5, b"r"), (None, text, 6, b"r")]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING, word INT, Removed BINARY")
    result = remove_repeats(frame)
    assert result.columns == ["doc_id", "text", "word", "Removed", "_removed", "kept"]
    found = sorted((row["word"], len(row["kept"]), len(row["_removed"])) for row in result.collect())
    # Of two texts with one id the earlier one is that of lesser hash.
    assert found in ([(1, 0, 1), (2, 130, 1), (2, 130, 1), (3, 120, 0), (4, 0, 0), (5, 0, 0), (6, 0, 1)],
                     [(1, 0, 1), (2, 250, 0), (2, 250, 0), (3, 0, 1), (4, 0, 0), (5, 0, 0), (6, 0, 1)])
    assert remove_repeats(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(frame, 20)


def test_many_copies_and_common_passages(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY_ROWS", 20)
    rng = random.Random(2)
    line, copy = prose(rng, 140), prose(rng, 400)
    rows = [(k, copy if k % 3 == 0 else prose(rng, 90) + line + prose(rng, 90)) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(9)
    assert found_of(frame) == by_force(rows)


def test_merged_runs():
    starts, stops = merged(np.array([5, 0, 9, 20, 21]), np.array([8, 5, 12, 30, 25]))
    assert starts.tolist() == [0, 9, 20] and stops.tolist() == [8, 12, 30]


def test_other_lengths(spark):
    rng = random.Random(4)
    common = prose(rng, 700)
    rows = [(0, prose(rng, 100) + common), (1, common[3:690] + prose(rng, 90)), (2, common[:40] + "Y" + common[41:])]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    for length in (32, 50, 333):
        found = {row["doc_id"]: hashlib.md5(row["kept"]).hexdigest() for row in remove_repeats(frame, length).collect()}
        assert found == {doc: hashlib.md5(kept).hexdigest() for doc, (_, kept) in by_force(rows, length).items()}
