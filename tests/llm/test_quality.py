import zlib

import numpy as np
import pyarrow as pa
import pytest

from formlens.llm.quality import BUCKETS, RANK, STRUCTURE, FactorisationMachine, features, score_quality, train


def test_pairs_by_the_sum_of_squares(spark):
    machine = FactorisationMachine()
    draw = np.random.default_rng(1)
    machine.weights, machine.factors = draw.normal(size=BUCKETS + STRUCTURE), draw.normal(size=(BUCKETS + STRUCTURE, RANK))
    bounds, columns, values = machine.inputs(features(pa.array(["one two two", "", "é 12!"]), np.array([3.0, np.nan, 7.0])))
    raw, _ = machine.forward(bounds, columns, values)
    for row in range(3):
        own = range(bounds[row], bounds[row + 1])
        plain = machine.bias + sum(machine.weights[columns[i]] * values[i] for i in own)
        plain += sum(
            machine.factors[columns[i]] @ machine.factors[columns[j]] * values[i] * values[j] for i in own for j in own if i < j
        )
        assert raw[row] == pytest.approx(plain)


def test_learns_an_interaction(spark):
    """Label 1 if exactly one of two words is there: no linear model of the words can tell."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(1500):
        a, b = rng.integers(0, 2, 2)
        words = rng.choice(["tree", "house", "road", "river"], 4).tolist() + ["alpha"] * a + ["omega"] * b
        rows.append((k, " ".join(words), 5))
        labels.append((k, int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    machine = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), epochs=40)
    truth = dict(labels)
    held = [r for r in score_quality(docs, machine).collect() if r.held_out]
    assert len(held) > 400 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, 0.1), (2, "", 0, 0.1), (None, "words here", 10, 0.1), (3, "x " * 50_000, 100_000, None), (3, "x", 1, 0.1), (3, "x", 1, 0.1)],
        "doc_id long, text string, n_chars long, score double",
    )
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (77, 1), (2, 5)], "doc_id long, quality int")
    rows = score_quality(docs, train(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert score_quality(docs.limit(0), FactorisationMachine()).count() == 0
    none = train(docs.drop("n_chars"), labels.limit(0))
    assert {r.score for r in score_quality(docs.drop("n_chars"), none).collect()} != set()


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} other", 5) for k in range(300)], "doc_id long, text string, n_chars long")
    labels = [(k, k % 2) for k in range(300)]
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, y in labels]
    scores = []
    for each in (labels, turned):
        machine = train(docs, spark.createDataFrame(each, "doc_id long, quality int"))
        scores.append(sorted((r.doc_id, r.score) for r in score_quality(docs, machine).collect()))
    assert scores[0] == scores[1]


def test_shared_documents_on_held_out_rows(spark):
    from formlens.llm.queries import op1_quality

    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op1_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
