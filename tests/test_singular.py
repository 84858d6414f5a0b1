import numpy as np
import pytest

from formlens.operators import directions, singular
from formlens.operators.singular import singular_directions, tree_factor


def table(spark, x, n_parts=5):
    rows = [(i, row.tolist()) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id BIGINT, diff ARRAY<DOUBLE>").repartition(n_parts)


def found_of(frame):
    return sorted(frame.collect(), key=lambda row: row["component"])


def with_values(rng, n, values):
    width = len(values)
    left, _ = np.linalg.qr(rng.normal(size=(n, width)))
    right, _ = np.linalg.qr(rng.normal(size=(width, width)))
    return left * values @ right, right


def test_small_singular_values_keep_their_digits(spark):
    values = 10.0 ** -np.arange(0, 12)
    x, right = with_values(np.random.default_rng(1), 300, values)
    rows = found_of(singular_directions(table(spark, x, 7), 12))
    assert np.allclose([r["singular_value"] for r in rows], values, rtol=1e-3, atol=0)
    assert all(abs(np.dot(r["vector"], axis)) > 1 - 1e-6 for r, axis in zip(rows, right, strict=True))
    squared = found_of(directions.principal_directions(table(spark, x), 12))
    assert squared[-1]["singular_value"] == 0.0 and rows[0]["total_variance"] == pytest.approx(np.sum(values**2))


@pytest.mark.parametrize("center", [False, True])
def test_equal_to_principal_directions(spark, center):
    x = np.random.default_rng(2).normal(size=(150, 9)) + 0.3
    frame = table(spark, x)
    expected = found_of(directions.principal_directions(frame, 4, center=center, prepend_mean=True))
    for parameters in ({}, {"direct_width": 4, "rounds": 30}):
        rows = found_of(singular_directions(frame, 4, center=center, prepend_mean=True, **parameters))
        assert [(r["component"], r["kind"]) for r in rows] == [(r["component"], r["kind"]) for r in expected]
        for row, other in zip(rows, expected, strict=True):
            assert np.allclose(row["vector"], other["vector"], atol=1e-7)
            assert row["total_variance"] == pytest.approx(other["total_variance"])
            assert row["singular_value"] == pytest.approx(other["singular_value"])


def test_wide_vectors_without_a_square_matrix(spark, monkeypatch):
    rng, width = np.random.default_rng(3), 20_000
    values = np.array([9.0, 5.0, 2.0, 1e-6])
    right, _ = np.linalg.qr(rng.normal(size=(width, 4)))
    left, _ = np.linalg.qr(rng.normal(size=(40, 4)))
    # A square matrix would have 3.2 GB; 14 vectors have 2.24 MB.
    rows = found_of(singular_directions(table(spark, left * values @ right.T, 4), 4, max_bytes=2_300_000))
    assert np.allclose([r["singular_value"] for r in rows], values, rtol=1e-6)
    assert all(abs(np.dot(r["vector"], axis)) > 1 - 1e-8 for r, axis in zip(rows, right.T, strict=True))
    with pytest.raises(ValueError, match="bytes"):
        singular_directions(table(spark, np.ones((30, 2000))), 10, max_bytes=1000)


def test_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(singular, "FAN_IN", 2)
    x = np.random.default_rng(4).normal(size=(90, 3))
    factor = tree_factor(table(spark, x, 9).select("diff"), lambda rows: rows)
    assert factor.shape == (3, 3) and np.allclose(factor.T @ factor, x.T @ x)


def test_odd_tables(spark):
    assert len(singular_directions(table(spark, np.eye(5)[:2]), 4).collect()) == 2
    zeros = found_of(singular_directions(table(spark, np.zeros((3, 2))), 2))
    assert [r["singular_value"] for r in zeros] == [0.0, 0.0]
    nulls = spark.createDataFrame([(None,), ([3.0, 4.0],)], "diff ARRAY<DOUBLE>")
    assert found_of(singular_directions(nulls, 2))[0]["singular_value"] == pytest.approx(5.0)
    for rows, message in (([([1.0, 2.0],), ([1.0],)], "vectors of"), ([([1.0, float("nan")],)], "NaN"), ([], "no vectors")):
        with pytest.raises(Exception, match=message):
            singular_directions(spark.createDataFrame(rows, "diff ARRAY<DOUBLE>"), 1)
    with pytest.raises(ValueError, match="positive"):
        singular_directions(nulls, 0)
