import random

from formlens.llm.line_dedup import dedup_lines, kept_ranges


def brute_force(rows, min_words):
    """Delete every line in a run of min_words words that occurs earlier, by comparing all runs."""
    docs = sorted(((i, text.split("\n")) for i, text in rows if text is not None), key=lambda row: (row[0] is None, row[0] or 0))
    seen, out = {}, {}
    for i, lines in docs:
        folded = [" ".join(line.split()) for line in lines]
        gone = set()
        for start in range(len(lines)):
            for stop in range(start + 1, len(lines) + 1):
                if sum(len(line.split()) for line in folded[start:stop]) >= min_words:
                    run = tuple(folded[start:stop])
                    if seen.setdefault(run, (i, start)) != (i, start):
                        gone.update(range(start, stop))
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone), len(gone)
    return out


def test_random_documents(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choices("abcdef", k=rng.randint(0, 5))) for _ in range(9)]
    rows = [(k * 7, "\n".join(rng.choices(lines, k=rng.randint(1, 14)))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_deleted) for r in dedup_lines(docs, min_words=6).collect()}
    assert got == brute_force(rows, 6)


def test_shared_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.text, r.n_deleted) for r in dedup_lines(docs).collect()}
    assert got == brute_force([tuple(r) for r in docs.collect()], 50)
    assert any(n for _, n in got.values())


def test_odd_rows(spark):
    passage = "\n".join("word " * 20 + str(k) for k in range(3))
    rows = [
        (1, passage, 5, "a"), (2, None, None, "b"), (3, "", 1, "c"), (None, "x\n" + passage + "\ny", 2, "d"),
        (4, passage.replace(" ", "  "), 3, "e"), (5, "short\nshort", 4, None), (5, "short\nshort", 4, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, key string")
    result = dedup_lines(docs)
    assert result.columns == ["doc_id", "text", "n_lines", "key", "_n_lines", "n_deleted"]
    got = {r.key: (r.doc_id, r.text, r.n_lines, r._n_lines, r.n_deleted) for r in result.collect() if r.key}
    assert got == {
        "a": (1, passage, 5, 3, 0), "b": (2, None, None, 0, 0), "c": (3, "", 1, 1, 0),
        "d": (None, "x\ny", 2, 5, 3), "e": (4, "", 3, 3, 3),
    }
    assert result.filter("key IS NULL AND text = 'short\nshort' AND n_deleted = 0").count() == 2


def test_repeats_within_a_document_and_empty_table(spark):
    line = "again " * 60
    docs = spark.createDataFrame([(1, f"{line}\n{line}\nend")], "doc_id long, text string")
    assert dedup_lines(docs).first().text == f"{line}\nend"
    assert dedup_lines(docs.filter("doc_id > 1")).count() == 0


def test_kept_ranges():
    assert kept_ranges([(3, 5), (1, 2), (4, 6)], 8) == [(0, 1), (2, 1), (6, 2)]
    assert kept_ranges([(0, 4)], 4) == []


def test_blank_lines_take_linear_time():
    import random
    import time

    import numpy as np

    from formlens.llm.line_dedup import forward_windows, line_hashes, run_hashes, window_minima

    rng = random.Random(2)
    for _ in range(300):
        text = "\n".join(" ".join(rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.choice([0, 0, 1, 2, 7]))) for _ in range(rng.randrange(40)))
        hashes, words = line_hashes(text)
        order = (np.frombuffer(hashes, dtype="<u8")[::2] / np.maximum(words, 0.5)).tolist()
        plain = {min(range(a, b), key=order.__getitem__) for a, b in zip(*(x.tolist() for x in forward_windows(words, 6)), strict=True)}
        assert window_minima(hashes, words, 6) == sorted(plain)
    began = time.perf_counter()
    hashes, words = line_hashes("\n" * 1_000_000 + "word " * 60)
    assert len(window_minima(hashes, words, 50)) >= 1
    runs = [(k, 1_000_001) for k in range(0, 1_000_000, 10)]
    assert len(set(run_hashes(hashes, runs))) == len(runs)
    assert time.perf_counter() - began < 30
    # Equal long runs have equal hashes wherever they stand.
    a, _ = line_hashes("x\n" + "\n" * 100 + "y z")
    b, _ = line_hashes("q\nr\n" + "\n" * 100 + "y z\nw")
    assert list(run_hashes(a, [(1, 102)])) == list(run_hashes(b, [(2, 103)])) != list(run_hashes(b, [(1, 102)]))
