import random
import re
from collections import Counter

import numpy as np
import pytest

from formlens.llm import collocations as module
from formlens.llm.collocations import collocations, pair_hash, pair_hashes, segments
from formlens.sources.tables import stored

SCHEMA = "lang STRING, text STRING, doc_id LONG, n INT, Rank INT"


def by_force(rows, min_count, top, contained=80):
    counts = {}
    for lang, text in rows:
        f = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        for p, a in often.items():
            inside = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= contained * a for b in inside):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out, key=repr)


def found_of(spark, rows, *parameters):
    frame = spark.createDataFrame([(*row, 1, 2, 3) for row in rows], SCHEMA).repartition(5)
    result = collocations(frame, *parameters)
    assert result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted((tuple(row) for row in result.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "B", "bé", "cc", "Dd", "\x01", "日本", "É", "x y", "e's"]
    line = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = []
    for k in range(160):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", "\n", " ", " "]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "en", "fr", None]), text + (line if k % 3 else "")))
    rows += [("und", "a b a b"), ("de", None), ("de", ""), ("de", " \t\n"), ("loop", "ha ha ha ha ha ha"), ("loop", "Ha ha. ha, ha"), ("one", "x y " * 300)]
    assert found_of(spark, rows, 4, 50) == by_force(rows, 4, 50)
    assert found_of(spark, rows, 2, 7, 100) == by_force(rows, 2, 7, 100)


def test_long_texts_and_common_pairs(spark, monkeypatch):
    monkeypatch.setattr(module, "SEGMENT_BYTES", 50)
    monkeypatch.setattr(module, "HELD_GRAMS", 90)
    rng = random.Random(1)
    text = " ".join(f"it is {rng.choice('abcdefgh')}{rng.randrange(9)}" + rng.choice(["", "."]) for _ in range(3000))
    copies = " ".join(f"w{k}" for k in range(300))
    rows = [("en", text + "y" * 300)] + [("en", copies)] * 3 + [("fr", copies + " " + copies)]
    assert found_of(spark, rows, 2, 5000) == by_force(rows, 2, 5000)


def test_no_table_is_gathered_for_a_join(spark, monkeypatch):
    """However small Spark takes a table for, its rows are dealt out and not broadcast by the driver."""
    plans = []

    def plan_of(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(module, "stored", lambda frame, name: plans.append(plan_of(frame)) or stored(frame, name))
    frame = spark.createDataFrame([("en", "a b c d e f g a b d"), ("fr", "a b c d e")] * 3, "lang STRING, text STRING")
    plans.append(plan_of(collocations(frame, 2)))
    assert len(plans) > 8 and sum(plan.count("SortMergeJoin") for plan in plans) > 10
    assert not any("Broadcast" in plan for plan in plans)


def test_empty_tables(spark):
    assert found_of(spark, []) == [] and found_of(spark, [("en", "too few"), ("en", None)]) == []


@pytest.mark.parametrize("text", [b"", b"One, two\tTHREE\x0b\x0cfour \xc3\x89.", b"." * 5, b"a" * 100])
def test_words_of_pieces(text, monkeypatch):
    monkeypatch.setattr(module, "SEGMENT_BYTES", 4)
    found = [word for part in segments(text) for word in part]
    plain = re.findall(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text))
    assert found == [b"\xff" if re.fullmatch(rb"[.,;:!?\x0A-\x0D]", word) else word for word in plain]


def test_pair_hashes_are_those_of_spark(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(1 << 63), (1 << 63) - 1, size=(2, 50), dtype=np.int64)
    frame = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long")
    frame = frame.withColumn("pair", pair_hash("a", "b")).withColumn("second", pair_hash("a", "pair"))
    hashes, second = zip(*frame.select("pair", "second").collect(), strict=True)
    assert pair_hashes(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist() == list(hashes)
    assert list(second) == b.tolist()
