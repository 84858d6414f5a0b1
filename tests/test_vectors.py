import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from formlens.functions.vectors import cosine, unit_difference
from formlens.operators import differences, directions, projection
from formlens.operators import states as st
from formlens.plans.studies import format_directions

STATES = "format_id INT, example_id BIGINT, layer INT, embedding ARRAY<FLOAT>"
WIDTH = 12


@pytest.fixture(scope="module")
def cube():
    """States by layer, format and example: formats shift every example along a few axes."""
    rng = np.random.default_rng(11)
    base, shift = rng.normal(size=(2, 1, 40, WIDTH)), rng.normal(size=(2, 5, 1, WIDTH))
    return (base + shift + 0.1 * rng.normal(size=(2, 5, 40, WIDTH))).astype(np.float32)


@pytest.fixture(scope="module")
def states(spark, cube):
    rows = [(f, e, l, cube[l, f, e].tolist()) for l in range(2) for f in range(5) for e in range(40)]
    return spark.createDataFrame(rows, STATES).repartition(6)


@pytest.fixture(scope="module")
def contrast_matrix(cube):
    x = cube[1].astype(np.float64)
    d = np.concatenate([x[2] - x[f] for f in range(5) if f != 2])
    return d / (np.linalg.norm(d, axis=1, keepdims=True) + 1e-8)


def table(spark, vectors, name="diff"):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], f"vec_id BIGINT, {name} ARRAY<DOUBLE>")


def frame(df):
    return {r["component"]: r for r in df.collect()}


def test_zero_difference_stays_zero(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([3.0, 0.0], [0.0, 4.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    found = [r["d"] for r in df.select(unit_difference(1e-8)("a", "b").alias("d")).collect()]
    assert found[0] == [0.0, 0.0] and found[1] == pytest.approx([0.6, -0.8])


def test_cosine_of_a_zero_vector_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    found = [r["c"] for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert found == [None, pytest.approx(math.sqrt(0.5))]


def test_layers(states):
    assert st.select_layer(states, 0).count() == 200
    assert {r["layer"] for r in st.select_layer(states, fraction=0.55).select("layer").distinct().collect()} == {1}
    assert {r["layer"] for r in st.select_layer(states, fraction=0.4).select("layer").distinct().collect()} == {0}
    assert {r["layer"] for r in st.select_layer(states, fraction=0.55, includes_input=True).select("layer").distinct().collect()} == {0}
    for wrong in ({}, {"layer": 1, "fraction": 0.5}):
        with pytest.raises(ValueError):
            st.select_layer(states, **wrong)


def test_last_token(spark):
    rows = [(0, 7, 0, p, [float(p)]) for p in (3, 11, 2)] + [(0, 8, 0, 0, [5.0])]
    tokens = spark.createDataFrame(rows, "format_id INT, example_id BIGINT, layer INT, position INT, embedding ARRAY<FLOAT>")
    assert {r["example_id"]: r["embedding"] for r in st.last_token_states(tokens).collect()} == {7: [11.0], 8: [5.0]}


def test_quality_finds_broken_and_ragged_vectors(spark):
    rows = [(0, 1, 0, [1.0, 2.0]), (0, 2, 0, [float("nan"), 2.0]), (1, 1, 0, [float("-inf")]), (1, 2, 0, [1.0, 2.0]), (2, 1, 0, [1.0])]
    found = {r["format_id"]: tuple(r)[2:] for r in st.vector_quality(spark.createDataFrame(rows, STATES)).collect()}
    assert found == {0: (2, 2, 2, True), 1: (2, 1, 2, True), 2: (1, 1, 1, False)}


def test_sampled_pairs_are_differences_of_the_same_example(states, cube):
    layer = st.select_layer(states, 1)
    pairs = differences.sampled_format_pairs(layer, 6, 10, 24)
    rows = differences.format_pair_diffs(layer, pairs).collect()
    assert len(rows) == 60 == pairs.count()
    for r in rows:
        d = cube[1, r["fmt_a"], r["example_id"]].astype(float) - cube[1, r["fmt_b"], r["example_id"]]
        assert r["fmt_a"] != r["fmt_b"] and np.allclose(r["diff"], d / np.linalg.norm(d), atol=1e-6)


def test_pairs_without_a_vector_are_dropped(spark, states):
    pairs = spark.createDataFrame([(0, 0, 1, 5), (1, 0, 99, 5)], "pair_id BIGINT, fmt_a INT, fmt_b INT, example_id BIGINT")
    found = differences.format_pair_diffs(st.select_layer(states, 1), pairs, strict=False).collect()
    assert [r["pair_id"] for r in found] == [0]


def test_contrasts_are_one_row_per_other_state(states, contrast_matrix):
    rows = differences.contrast_diffs(st.select_layer(states, 1), 2).orderBy("fmt_b", "example_id").collect()
    assert np.allclose([r["diff"] for r in rows], contrast_matrix, atol=1e-9)


def test_gram_and_directions_equal_the_svd(states, contrast_matrix):
    diffs = differences.contrast_diffs(st.select_layer(states, 1), 2).repartition(7)
    _, s, vh = np.linalg.svd(contrast_matrix, full_matrices=False)
    found = frame(directions.principal_directions(diffs, 20))
    assert len(found) == WIDTH and {r["kind"] for r in found.values()} == {"principal"}
    vectors = np.array([found[i]["vector"] for i in range(WIDTH)])
    assert np.allclose([found[i]["singular_value"] for i in range(WIDTH)], s)
    assert np.allclose(vectors @ vectors.T, np.eye(WIDTH), atol=1e-9)
    assert np.allclose(np.abs(np.sum(vectors * vh, axis=1)), 1.0, atol=1e-6)
    assert vectors[0] @ contrast_matrix.mean(axis=0) > 0
    assert all(v[np.argmax(np.abs(v))] > 0 for v in vectors[1:])
    assert found[0]["total_variance"] == pytest.approx(np.sum(s**2))


def test_centred_directions_with_the_mean_first(spark, contrast_matrix):
    mean = contrast_matrix.mean(axis=0)
    _, s, vh = np.linalg.svd(contrast_matrix - mean, full_matrices=False)
    found = frame(directions.principal_directions(table(spark, contrast_matrix), 3, center=True, prepend_mean=True))
    assert [found[i]["kind"] for i in range(4)] == ["mean", "principal", "principal", "principal"]
    assert np.allclose(found[0]["vector"], mean / np.linalg.norm(mean))
    for i in range(3):
        assert found[i + 1]["singular_value"] == pytest.approx(s[i])
        assert abs(np.dot(found[i + 1]["vector"], vh[i])) == pytest.approx(1.0)


def test_at_most_as_many_directions_as_vectors(spark):
    assert len(frame(directions.principal_directions(table(spark, np.eye(5)[:2]), 4))) == 2
    with pytest.raises(ValueError, match="no vectors"):
        directions.principal_directions(table(spark, np.eye(2)).filter("vec_id > 5"), 1)
    with pytest.raises(ValueError, match="positive"):
        directions.principal_directions(table(spark, np.eye(2)), 0)


def test_explained_variance(spark, contrast_matrix):
    rows = directions.explained_variance(directions.principal_directions(table(spark, contrast_matrix), 4)).orderBy("component").collect()
    s2 = np.linalg.svd(contrast_matrix, compute_uv=False) ** 2
    assert np.allclose([r["share"] for r in rows], s2[:4] / s2.sum())
    assert np.allclose([r["running_share"] for r in rows], np.cumsum(s2[:4]) / s2.sum())
    flat = directions.explained_variance(directions.principal_directions(table(spark, np.zeros((3, 2))), 2)).collect()
    assert [r["share"] for r in flat] == [None, None]


def test_group_statistics(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6))
    target = np.arange(90) % 3 == 0
    rows = [(i, bool(target[i]), x[i].tolist()) for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, is_target BOOLEAN, embedding ARRAY<DOUBLE>").repartition(9)
    mean = x[target].mean(axis=0) - x[~target].mean(axis=0)
    assert np.allclose(directions.group_mean_direction(vectors).collect()[0]["vector"], mean / np.linalg.norm(mean))
    means = {r["is_target"]: r for r in directions.group_means(vectors, "is_target").collect()}
    assert means[True]["n_rows"] == 30 and np.allclose(means[False]["mean"], x[~target].mean(axis=0))
    rows = differences.group_pair_diffs(vectors, 50, 24).collect()
    possible = {tuple(np.round((a - b) / np.linalg.norm(a - b), 6)) for a in x[target] for b in x[~target]}
    assert len(rows) == 50 and all(tuple(np.round(r["diff"], 6)) in possible for r in rows)
    with pytest.raises(Exception, match="both groups"):
        directions.group_mean_direction(vectors.filter("is_target")).collect()


def test_similarity_matrix(spark):
    named = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [-2.0, 0.0])], "name STRING, vector ARRAY<DOUBLE>")
    found = {(r["name_a"], r["name_b"]): round(r["cosine"], 6) for r in directions.direction_similarity(named).collect()}
    assert len(found) == 9 and found["a", "c"] == -1.0 and found["b", "a"] == round(math.sqrt(0.5), 6)


def axes_table(spark, axes):
    return spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(axes)], "component INT, vector ARRAY<DOUBLE>")


def test_projection_leaves_nothing_along_the_directions(spark):
    rng = np.random.default_rng(4)
    x, axes = rng.normal(size=(30, 6)), np.linalg.qr(rng.normal(size=(6, 3)))[0].T
    vectors, table_of_axes = table(spark, x, "embedding"), axes_table(spark, 5 * axes)
    after = projection.project_out_all(vectors, table_of_axes)
    found = np.array([r["embedding"] for r in after.orderBy("vec_id").collect()])
    assert np.allclose(found, x - x @ axes.T @ axes)
    sizes = frame(projection.projection_residual(vectors, after, table_of_axes))
    assert all(sizes[i]["max_after"] < 1e-9 for i in range(3))
    assert sizes[1]["mean_before"] == pytest.approx(np.abs(x @ axes[1]).mean())
    half = projection.project_out(vectors, table_of_axes.filter("component = 0"), 0.5)
    assert np.allclose([r["embedding"] for r in half.orderBy("vec_id").collect()], x - 0.5 * np.outer(x @ axes[0], axes[0]))
    with pytest.raises(ValueError, match="exactly one"):
        projection.project_out(vectors, table_of_axes)


def test_oblique_directions_are_taken_out_in_order(spark):
    x, axes = np.array([[1.0, 2.0]]), np.array([[1.0, 0.0], [0.6, 0.8]])
    found = projection.project_out_all(table(spark, x, "embedding"), axes_table(spark, axes)).collect()[0]["embedding"]
    step = x[0] - (x[0] @ axes[0]) * axes[0]
    assert np.allclose(found, step - (step @ axes[1]) * axes[1])


def test_column_side_projection(spark):
    rng = np.random.default_rng(6)
    axis = rng.normal(size=4)
    axis /= np.linalg.norm(axis)
    matrices = rng.normal(size=(3, 4, 5))
    rows = [(m, i, matrices[m, i].tolist()) for m in range(3) for i in range(4)]
    table_of_rows = spark.createDataFrame(rows, "matrix_id BIGINT, row_idx INT, values ARRAY<DOUBLE>").repartition(5)
    direction = axes_table(spark, axis[None])
    found = {(r["matrix_id"], r["row_idx"]): r["values"] for r in projection.project_out_columns(table_of_rows, direction).collect()}
    for m in range(3):
        expected = matrices[m] - np.outer(axis, axis @ matrices[m])
        assert np.allclose([found[m, i] for i in range(4)], expected)
    with pytest.raises(Exception, match="4 rows"):
        projection.project_out_columns(table_of_rows.filter("row_idx < 3"), direction).collect()


def test_column_side_projection_of_matrices_with_missing_rows(spark):
    axis = np.array([3.0, 0.0, 4.0]) / 5
    rows = [(0, i, [float(i + 1), 2.0]) for i in range(3)] + [(1, 0, [5.0, 1.0]), (2, 2, [1.0, 0.0]), (2, 1, [7.0, 7.0])]
    fields = "matrix_id BIGINT, row_idx INT, values ARRAY<DOUBLE>"
    direction = axes_table(spark, axis[None])
    found = projection.project_out_columns(spark.createDataFrame(rows, fields).repartition(3), direction, partial=True).collect()
    matrices = np.zeros((3, 3, 2))
    for m, i, values in rows:
        matrices[m, i] = values
    expected = {(m, i): matrices[m, i] - axis[i] * (axis @ matrices[m]) for m, i, _ in rows}
    assert len(found) == len(rows)
    assert all(np.allclose(r["values"], expected[r["matrix_id"], r["row_idx"]]) for r in found)
    for more in ((1, 0, [5.0, 1.0]), (1, 3, [5.0, 1.0]), (1, -1, [5.0, 1.0])):
        with pytest.raises(Exception, match="each once|out of bounds|row -1"):
            projection.project_out_columns(spark.createDataFrame([*rows, more], fields), direction, partial=True).collect()


def test_directions_from_states(states):
    for options in ({}, {"target_format": 1}):
        found = frame(format_directions(states, 1, 3, 24, n_blocks=8, block_size=16, **options))
        assert len(found) == 3 and found[0]["singular_value"] >= found[1]["singular_value"]


BAD = {"ragged": [[1.0, 2.0], [1.0, 2.0, 3.0]], "null entry": [[1.0, None], [1.0, 2.0]]}


@pytest.mark.parametrize("kind", BAD)
def test_bad_vectors_are_errors(spark, kind):
    rows = [(0, 0, BAD[kind][0]), (1, 0, BAD[kind][1]), (0, 1, BAD[kind][0]), (1, 1, BAD[kind][1])]
    states = spark.createDataFrame(rows, "format_id INT, example_id BIGINT, embedding ARRAY<DOUBLE>").coalesce(1)
    axes = spark.createDataFrame([(0, [1.0, 0.0])], "component INT, vector ARRAY<DOUBLE>")
    pairs = spark.createDataFrame([(0, 0, 1, 0)], "pair_id BIGINT, fmt_a INT, fmt_b INT, example_id BIGINT")
    for job in (
        lambda: differences.contrast_diffs(states, 0).collect(),
        lambda: differences.format_pair_diffs(states, pairs).collect(),
        lambda: directions.principal_directions(states, 1, column="embedding"),
        lambda: projection.project_out_all(states, axes).collect(),
        lambda: projection.projection_residual(states, states, axes).collect(),
    ):
        with pytest.raises(Exception, match="vector"):
            job()


def test_null_vectors_stay_null(spark):
    states = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0])], "vec_id BIGINT, embedding ARRAY<DOUBLE>").coalesce(1)
    axes = spark.createDataFrame([(0, [1.0, 0.0])], "component INT, vector ARRAY<DOUBLE>")
    found = projection.project_out_all(states, axes).orderBy("vec_id").collect()
    assert [r["embedding"] for r in found] == [[0.0, 2.0], None, [0.0, 4.0]]
    assert [r["embedding"] for r in projection.project_out_all(states.filter("vec_id = 1"), axes).collect()] == [None]


def test_nan_and_equal_means_are_errors(spark):
    with pytest.raises(Exception, match="NaN"):
        directions.principal_directions(table(spark, np.array([[1.0, float("nan")], [1.0, 2.0]])), 1)
    same = spark.createDataFrame([(True, [1.0, 2.0]), (False, [1.0, 2.0])], "is_target BOOLEAN, embedding ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="equal means"):
        directions.group_mean_direction(same).collect()
    with pytest.raises(Exception, match="over 100 bytes"):
        directions.principal_directions(table(spark, np.eye(5)), 1, max_bytes=100)


def test_pairs_are_drawn_among_common_examples(spark):
    rows = [(f, e, [float(f + 1), float(e)]) for f in range(3) for e in range(40) if f == 0 or e % (f + 1)]
    states = spark.createDataFrame(rows, "format_id INT, example_id BIGINT, embedding ARRAY<DOUBLE>")
    pairs = differences.sampled_format_pairs(states, 8, 8, 24)
    assert differences.format_pair_diffs(states, pairs).count() == 64 == pairs.count()
    with pytest.raises(ValueError, match="no example"):
        differences.sampled_format_pairs(states.filter("format_id = 0 AND example_id < 5 OR format_id = 1 AND example_id > 5"), 1, 1, 1)
    missing = spark.createDataFrame([(0, 0, 9, 1)], "pair_id BIGINT, fmt_a INT, fmt_b INT, example_id BIGINT")
    with pytest.raises(Exception, match="missing for pair 0"):
        differences.format_pair_diffs(states, missing).collect()


def test_last_tokens_are_found_without_sorting_vectors(spark):
    rows = [(0, 7, 0, p, [float(p)]) for p in range(5)]
    tokens = spark.createDataFrame(rows, "format_id INT, example_id BIGINT, layer INT, position INT, embedding ARRAY<FLOAT>")
    plan = st.last_token_states(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
