"""Taking directions out of vector and matrix tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlens.functions.vectors import as_lists, as_matrix, each_vector
from formlens.operators.directions import MAX_BYTES


def direction_matrix(directions: DataFrame, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The directions in component order as unit rows; their bytes are counted before they are fetched."""
    n_bytes = directions.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    if n_bytes > max_bytes:
        raise ValueError(f"directions of {n_bytes} bytes, over {max_bytes}")
    rows = directions.select("component", "vector").collect()
    axes = np.array([row["vector"] for row in sorted(rows, key=lambda row: row["component"])], dtype=np.float64)
    lengths = np.linalg.norm(axes, axis=1, keepdims=True)
    return np.divide(axes, lengths, out=np.zeros_like(axes), where=lengths > 0)


def project_out_all(
    vectors: DataFrame, directions: DataFrame, weight: float = 1.0, column: str = "embedding"
) -> DataFrame:
    """``x - weight (x·v) v`` for one direction after another, in component order; null stays null."""
    axes = vectors.sparkSession.sparkContext.broadcast(direction_matrix(directions))

    @F.arrow_udf("array<double>")
    def without_axes(batch: pa.Array) -> pa.Array:
        def change(x: np.ndarray) -> np.ndarray:
            for axis in axes.value:
                x = x - weight * np.outer(x @ axis, axis)
            return x

        return each_vector(batch, change)

    return vectors.withColumn(column, without_axes(F.col(column)))


def project_out(
    vectors: DataFrame, direction: DataFrame, weight: float = 1.0, column: str = "embedding"
) -> DataFrame:
    """``project_out_all`` for a table with exactly one ``vector``."""
    single = direction.select(F.lit(0).alias("component"), "vector")
    if len(single.limit(2).collect()) != 1:
        raise ValueError("give exactly one direction")
    return project_out_all(vectors, single, weight, column)


def project_out_columns(matrices: DataFrame, direction: DataFrame, weight: float = 1.0, partial: bool = False) -> DataFrame:
    """``M - weight v (vᵀM)`` for matrices stored by rows (``matrix_id, row_idx, values``).

    ``vᵀM`` is a weighted sum of rows, combined before the shuffle. Every matrix must have
    exactly as many rows as the direction has entries, so no matrix can dominate the join.
    With ``partial`` it may lack some: a missing row counts as zeros, and none is made up for it. A row
    that comes twice is an error then.
    """
    unit = direction_matrix(direction.select(F.lit(0).alias("component"), "vector"))
    if len(unit) != 1:
        raise ValueError("give exactly one direction")
    axis = matrices.sparkSession.sparkContext.broadcast(unit[0])

    @F.arrow_udf("array<double>")
    def scaled(rows: pa.Array, positions: pa.Array) -> pa.Array:
        return as_lists(as_matrix(rows) * _entries(axis.value, positions)[:, None])

    @F.arrow_udf("array<double>")
    def shifted(rows: pa.Array, positions: pa.Array, column_sums: pa.Array) -> pa.Array:
        share = weight * _entries(axis.value, positions)[:, None]
        return as_lists(as_matrix(rows) - share * as_matrix(column_sums))

    weighted = matrices.select("matrix_id", array_to_vector(scaled("values", "row_idx")).alias("_row"))
    sums = [Summarizer.sum(F.col("_row")).alias("_row"), F.count("*").alias("_rows")]
    misfit = F.raise_error(F.lit(f"a matrix must have {len(unit[0])} rows to fit the direction"))
    fits = F.col("_rows") == len(unit[0])
    if partial:
        # Places are checked where the axis is looked up, so different ones are no more than the axis has.
        weighted = matrices.select("matrix_id", "row_idx", array_to_vector(scaled("values", "row_idx")).alias("_row"))
        sums.append(F.size(F.collect_set("row_idx")).alias("_places"))
        fits = F.col("_rows") == F.col("_places")
        misfit = F.raise_error(F.lit(f"a matrix must have {len(unit[0])} rows at most, each once, to fit the direction"))
    merged = weighted.groupBy("matrix_id").agg(*sums)
    fitting = F.when(fits, vector_to_array("_row")).otherwise(misfit)
    joined = matrices.join(merged.select("matrix_id", fitting.alias("_sums")), "matrix_id")
    return joined.select("matrix_id", "row_idx", shifted("values", "row_idx", "_sums").alias("values"))


def _entries(axis: np.ndarray, positions: pa.Array) -> np.ndarray:
    """``axis`` at the row positions; a matrix with more rows than the axis is an error."""
    places = positions.to_numpy(zero_copy_only=False)
    if (places < 0).any():
        raise IndexError(f"row {places.min()} of a matrix")
    return axis[places]


def projection_residual(before: DataFrame, after: DataFrame, directions: DataFrame) -> DataFrame:
    """Per direction: the largest and the mean |x·v| before and after."""
    axes = directions.sparkSession.sparkContext.broadcast(direction_matrix(directions))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per direction and batch: the largest overlap, their sum, and the rows."""
        for batch in batches:
            sizes = np.abs(as_matrix(batch.column(0)) @ axes.value.T) if batch.num_rows else np.zeros((0, 0))
            if not sizes.size:
                continue
            n = sizes.shape[1]
            yield pa.RecordBatch.from_pydict(
                {
                    "position": np.arange(n, dtype=np.int32),
                    "largest": sizes.max(axis=0),
                    "total": sizes.sum(axis=0),
                    "n": np.full(n, len(sizes), dtype=np.int64),
                }
            )

    def summary(vectors: DataFrame, when: str) -> DataFrame:
        kept = vectors.select("embedding").filter("embedding IS NOT NULL")
        partial = kept.mapInArrow(reduced, "position INT, largest DOUBLE, total DOUBLE, n BIGINT")
        mean = F.sum("total") / F.sum("n")
        return partial.groupBy("position").agg(F.max("largest").alias(f"max_{when}"), mean.alias(f"mean_{when}"))

    order = Window.orderBy("component")  # as many rows as direction_matrix has fetched
    names = directions.select("component", (F.row_number().over(order) - 1).alias("position"))
    both = names.join(summary(before, "before"), "position").join(summary(after, "after"), "position")
    return both.drop("position")
