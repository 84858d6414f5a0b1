"""Hot keys: results stay whole, and the work is spread."""

import os

import pytest
from pyspark.sql import functions as F

from formlens.operators.differences import contrast_diffs
from formlens.operators.directions import group_means
from formlens.operators.scoring import align_generations, format_accuracy
from formlens.operators.states import select_layer
from formlens.sources.generations import read_stored_generations, write_generations
from formlens.sources.states import save_state_table


@pytest.fixture
def small_pieces(spark):
    """Settings under which a few hundred kB count as a skewed partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_accuracy_with_a_hot_example(spark, small_pieces):
    """Example 0 has a third of all generations, from as many experiments."""
    n = 60_000
    ids = spark.range(0, n, 1, 8)
    hot = ids.select(
        F.concat(F.lit("e"), F.col("id") % 20).alias("experiment"),
        (F.col("id") % 7).cast("int").alias("format_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("example_id"),
        F.concat(F.lit("text " * 5), (F.col("id") % 500 + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).cast("string")).alias("generation"),
    )
    examples = spark.range(500).select(
        F.col("id").alias("example_id"), F.lit("q").alias("question"), F.concat(F.lit("r ####"), F.col("id")).alias("answer")
    )
    expected = {}
    for i in range(n):
        example = 0 if i % 3 == 0 else i % 500
        total = expected.setdefault((f"e{i % 20}", i % 7), [0, 0])
        total[0] += i % 500 + (i % 4 == 0) == example
        total[1] += 1
    assert "skew=true" in final_plan(align_generations(hot, examples))
    found = {(r["experiment"], r["format_id"]): (r["accuracy"], r["n_scored"]) for r in format_accuracy(hot, examples, strict=False).collect()}
    assert found == {key: (pytest.approx(right / rows), rows) for key, (right, rows) in expected.items()}


def test_a_hot_format_is_written_by_many_tasks(spark, small_pieces, tmp_path):
    path = str(tmp_path / "generations")
    rows = spark.range(0, 20_000, 1, 8).select(
        F.lit("exp").alias("experiment"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(9).cast("int").alias("format_id"),
        F.col("id").alias("example_id"),
        F.sha2(F.col("id").cast("string"), 512).alias("generation"),
    )
    write_generations(rows, path)
    assert read_stored_generations(spark, path).count() == 20_000
    hot = os.listdir(os.path.join(path, "experiment=exp", "format_id=9"))
    assert 3 < len([name for name in hot if name.endswith(".parquet")]) < 200


def test_bucketed_states_are_joined_without_a_shuffle(spark, small_pieces):
    states = spark.range(0, 4_000, 1, 8).select(
        (F.col("id") % 4).cast("int").alias("format_id"),
        F.expr("id DIV 8").alias("example_id"),
        F.expr("CAST(id DIV 4 % 2 AS INT)").alias("layer"),
        F.array((F.col("id") % 13).cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
    )
    save_state_table(states, "bucketed_states", 8)
    plain = contrast_diffs(select_layer(states, 1), 2)
    bucketed = contrast_diffs(select_layer(spark.table("bucketed_states"), 1), 2)
    assert "Exchange" in final_plan(plain) and "Exchange" not in final_plan(bucketed)

    def rows(df):
        return sorted((r["fmt_a"], r["fmt_b"], r["example_id"], tuple(r["diff"])) for r in df.collect())

    assert rows(bucketed) == rows(plain) and bucketed.count() == 1_500
    spark.sql("DROP TABLE bucketed_states")


def test_means_of_a_hot_group_are_merged_by_slices(spark):
    vectors = spark.range(0, 9_000, 1, 24).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 11).otherwise(99).alias("label"),
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"),
    )
    expected = {}
    for i in range(9_000):
        expected.setdefault(i % 11 if i % 3 == 0 else 99, []).append(i)
    found = {r["label"]: (r["mean"], r["n_rows"]) for r in group_means(vectors, "label").collect()}
    assert found == {k: (pytest.approx([sum(v) / len(v), 1.0]), len(v)) for k, v in expected.items()}
