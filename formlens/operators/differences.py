"""Differences between states of the same example under two formats, or of two groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.functions.vectors import unit_difference
from formlens.operators.dimensions import as_array
from formlens.operators.sampling import draw, hash_ranked, sample_blocks
from formlens.sources.tables import stored

FORMAT_EPSILON = 1e-8
GROUP_EPSILON = 1e-12


def sampled_format_pairs(states: DataFrame, n_blocks: int, block_size: int, seed: int) -> DataFrame:
    """Blocks of two random formats and random examples, as ids found in ``states``.

    Examples are drawn among those that every format has, so no pair lacks a vector; without any
    such example it is an error.
    """
    spark = states.sparkSession
    ids = as_array(states.select("format_id").distinct(), "format_id")
    each = states.select("format_id", "example_id").distinct().groupBy("example_id").agg(F.count("*").alias("n_formats"))
    examples = stored(each.filter(F.col("n_formats") == F.size(ids)).select("example_id"), "common-examples")
    if examples.isEmpty():
        raise ValueError("no example has a state in every format")
    n_examples = examples.agg(F.count("*").alias("n")).scalar()
    drawn = stored(sample_blocks(spark, n_blocks, block_size, seed, F.size(ids), n_examples), "drawn-blocks")
    positions = drawn.select(F.col("example_pos").alias("sample_rank"))
    ranked = hash_ranked(examples, seed, "example_id", positions=positions).withColumnRenamed("sample_rank", "example_pos")

    def format_at(position: str) -> Column:
        return F.get(ids, F.col(position).cast("int"))["format_id"]

    return (
        drawn.join(ranked, "example_pos")
        .select("pair_id", format_at("first_pos").alias("fmt_a"), format_at("second_pos").alias("fmt_b"), "example_id")
    )


def format_pair_diffs(states: DataFrame, pairs: DataFrame, strict: bool = True) -> DataFrame:
    """Unit differences for a table of pairs ``pair_id, fmt_a, fmt_b, example_id``.

    Both vectors of a pair are picked in one pass over the states; Spark decides by its size how the
    pair table travels. A pair without both vectors is an error, or left out when not ``strict``.
    """
    sides = F.array(
        F.struct(F.lit(True).alias("is_first"), F.col("fmt_a").alias("format_id")),
        F.struct(F.lit(False).alias("is_first"), F.col("fmt_b").alias("format_id")),
    )
    wanted = pairs.select("*", F.explode(sides).alias("side")).select("pair_id", "fmt_a", "fmt_b", "example_id", "side.*")
    picked = states.select("format_id", "example_id", "embedding").join(wanted, ["format_id", "example_id"])
    keys = ["pair_id", "fmt_a", "fmt_b", "example_id"]
    picked = picked.select(*keys, "is_first", "embedding").unionByName(
        pairs.select(*keys, F.lit(None).cast("boolean").alias("is_first")), allowMissingColumns=True
    )
    paired = picked.groupBy(*keys).agg(
        F.first(F.when(F.col("is_first"), F.col("embedding")), ignorenulls=True).alias("first"),
        F.first(F.when(~F.col("is_first"), F.col("embedding")), ignorenulls=True).alias("second"),
    )
    if not strict:
        return _unit(paired.filter("first IS NOT NULL AND second IS NOT NULL"), FORMAT_EPSILON)
    missing = F.raise_error(F.concat(F.lit("a vector is missing for pair "), F.col("pair_id")))
    whole = F.when(F.col("first").isNull() | F.col("second").isNull(), missing).otherwise(F.col("first"))
    return _unit(paired.withColumn("first", whole), FORMAT_EPSILON)


def contrast_diffs(states: DataFrame, target_format: int | Column) -> DataFrame:
    """One format against every other one, for every example: one row per other state."""
    target_format = target_format if isinstance(target_format, Column) else F.lit(target_format)
    is_target = F.col("format_id") == target_format
    target = states.filter(is_target).select(
        "example_id", F.col("format_id").alias("fmt_a"), F.col("embedding").alias("first")
    )
    others = states.filter(~is_target).select(
        "example_id", F.col("format_id").alias("fmt_b"), F.col("embedding").alias("second")
    )
    return _unit(others.join(target, "example_id"), FORMAT_EPSILON, ["fmt_a", "fmt_b", "example_id"])


def group_pair_diffs(vectors: DataFrame, n_pairs: int, seed: int, key: str = "vec_id") -> DataFrame:
    """Unit differences of random target/baseline pairs, drawn with replacement.

    ``is_target`` tells the groups apart. Only ids are ranked; vectors are read for the
    drawn rows alone.
    """
    spark = vectors.sparkSession
    drawn_by_side = {}
    for name, is_target in (("left", True), ("right", False)):
        members = vectors.filter(F.col("is_target") == is_target).select(key)
        n_members = members.agg(F.count("*").alias("n")).scalar()
        drawn = spark.range(n_pairs).select(
            F.col("id").alias("pair_id"), draw(seed, F.col("id"), name, n_members).alias("sample_rank")
        )
        drawn = stored(drawn, "drawn-pairs")
        chosen = drawn.join(hash_ranked(members, seed, key, positions=drawn.select("sample_rank")), "sample_rank")
        drawn_by_side[name] = chosen.select("pair_id", key, F.lit(is_target).alias("is_first"))
    wanted = drawn_by_side["left"].unionByName(drawn_by_side["right"])
    picked = vectors.select(key, "embedding").join(wanted, key)
    paired = picked.groupBy("pair_id").agg(
        F.first(F.when(F.col("is_first"), F.col("embedding")), ignorenulls=True).alias("first"),
        F.first(F.when(~F.col("is_first"), F.col("embedding")), ignorenulls=True).alias("second"),
    )
    return _unit(paired, GROUP_EPSILON, ["pair_id"])


def _unit(paired: DataFrame, epsilon: float, keys: list[str] | None = None) -> DataFrame:
    keys = keys or [name for name in paired.columns if name not in ("first", "second")]
    return paired.select(*keys, unit_difference(epsilon)("first", "second").alias("diff"))
