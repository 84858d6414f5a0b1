"""The catalogue of prompt formats: a dimension of at most a few hundred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlens.fixed_values import (
    DESCRIPTORS,
    END_TAG,
    INSTRUCTION_TAG,
    RESPONSE_TAG,
    SEPARATORS,
    SPACES,
    TRANSFORMS,
)
from formlens.functions.text import transformed
from formlens.operators.dimensions import for_each_format
from formlens.operators.sampling import hash_key


def _pick(values: list[str], position: str) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), F.col(position) + 1)


def format_grid(
    spark: SparkSession,
    separators: list[str] = SEPARATORS,
    spaces: list[str] = SPACES,
    transforms: list[str] = TRANSFORMS,
) -> DataFrame:
    """All combinations, numbered with the separator as the slowest and the transform as the fastest index."""
    total = len(separators) * len(spaces) * len(transforms)
    numbered = spark.range(0, total, 1, 1).select(F.col("id").cast("int").alias("idx"))
    return grid_positions(numbered, len(spaces), len(transforms)).select(
        "*",
        _pick(separators, "separator_pos").alias("separator"),
        _pick(spaces, "space_pos").alias("space"),
        _pick(transforms, "transform_pos").alias("transform"),
    )


def grid_positions(numbered: DataFrame, n_spaces: int, n_transforms: int) -> DataFrame:
    """Decode ``idx`` into its three positions."""
    idx = F.col("idx")
    return numbered.select(
        "*",
        F.floor(idx / (n_spaces * n_transforms)).cast("int").alias("separator_pos"),
        F.pmod(F.floor(idx / n_transforms), F.lit(n_spaces)).cast("int").alias("space_pos"),
        F.pmod(idx, F.lit(n_transforms)).cast("int").alias("transform_pos"),
    )


def with_descriptors(
    specs: DataFrame,
    descriptors: tuple[str, str, str] = DESCRIPTORS,
    tags: tuple[str, str, str] = (INSTRUCTION_TAG, RESPONSE_TAG, END_TAG),
) -> DataFrame:
    names = ["first_descriptor", "second_descriptor", "third_descriptor", "instruction_tag", "response_tag", "end_tag"]
    return specs.select("*", *[F.lit(value).alias(name) for name, value in zip(names, descriptors + tags)])


def sample_formats(grid: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` distinct rows of the grid given in seeded order; ``format_id`` is the position in that order."""
    grid_size = grid.count()
    if not 0 < n <= grid_size:
        raise ValueError(f"cannot sample {n} distinct formats from {grid_size}")
    order = Window.orderBy(hash_key(seed, F.col("idx")), "idx")
    return grid.select((F.row_number().over(order) - 1).alias("format_id"), "*").filter(F.col("format_id") < n)


def label_descriptors(formats: DataFrame) -> DataFrame:
    """Add the three descriptors as they appear in prompts."""
    return formats.select(
        "*",
        *[
            transformed(F.col("transform"), F.col(f"{place}_descriptor")).alias(f"{place}_label")
            for place in ("first", "second", "third")
        ],
    )


def render_key(formats: DataFrame) -> DataFrame:
    """Add a key that is equal for formats which render every example alike."""
    parts = ["separator", "space", "first_label", "second_label", "third_label"]
    return label_descriptors(formats).withColumn("render_key", F.md5(F.to_json(F.array(*parts))))


def distinct_formats(formats: DataFrame) -> DataFrame:
    """One format per rendering, the one with the lowest ``format_id``."""
    order = Window.partitionBy("render_key").orderBy("format_id")
    ranked = render_key(formats).withColumn("_copy", F.row_number().over(order))
    return ranked.filter("_copy = 1").select(*formats.columns)


def split_formats(formats: DataFrame, n_test: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n_test`` sampled formats, and the others."""
    return formats.filter(F.col("format_id") < n_test), formats.filter(F.col("format_id") >= n_test)


def leaked_formats(test: DataFrame, train: DataFrame) -> DataFrame:
    """Training formats that render exactly like some test format."""
    return render_key(train).join(render_key(test).select("render_key"), "render_key", "left_semi").select(*train.columns)


def example_format_grid(examples: DataFrame, formats: DataFrame) -> DataFrame:
    """The work list of an experiment: one row per example and format."""
    pairs = for_each_format(examples.select("example_id"), formats.select("format_id"))
    return pairs.select("example_id", F.col("spec.format_id").alias("format_id"))


def pending_work(work: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """The rows of ``work`` without output.

    With keys down to the example this is one join on unique keys. To skip whole formats
    pass the *formats* as ``work`` and expand the rest by examples afterwards, so that no
    row-scale table is ever shuffled by a format key.
    """
    return work if force else work.join(done.select(*keys).distinct(), keys, "left_anti")


def available_formats(formats: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Formats with some output, and formats without any. Ids are kept, so nothing shifts."""
    seen = outputs.select("format_id").distinct()
    return formats.join(seen, "format_id", "left_semi"), formats.join(seen, "format_id", "left_anti")
