"""Mean and principal directions of vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlens import schemas
from formlens.functions.vectors import as_lists, as_matrix, cosine, unit_difference
from formlens.operators.dimensions import as_array

MAX_BYTES = 2 << 30
SUM_ROW = -1
NOISE = 1e-8
NO_VARIANCE = 1e-12
MEAN_SLICES = 256


def group_means(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean vector and row count per group.

    Two levels: tasks are merged by slices first, so the last merge of a group sees a
    bounded number of rows, however large the group is.
    """
    sliced = vectors.select(
        group, array_to_vector(vector).alias("_vector"), (F.spark_partition_id() % MEAN_SLICES).alias("_slice")
    ).filter("_vector IS NOT NULL")
    partial = sliced.groupBy(group, "_slice").agg(
        Summarizer.mean(F.col("_vector")).alias("_mean"), F.count("*").alias("_rows")
    )
    merged = partial.groupBy(group).agg(
        Summarizer.mean(F.col("_mean"), F.col("_rows").cast("double")).alias("_mean"), F.sum("_rows").alias("n_rows")
    )
    return merged.select(group, vector_to_array("_mean").alias("mean"), "n_rows")


def group_mean_direction(vectors: DataFrame) -> DataFrame:
    """Unit difference of the mean of the target rows and the mean of the others (``is_target``)."""
    means = group_means(vectors, "is_target")
    both = means.agg(
        F.first(F.when(F.col("is_target"), F.col("mean")), ignorenulls=True).alias("target"),
        F.first(F.when(~F.col("is_target"), F.col("mean")), ignorenulls=True).alias("baseline"),
    )
    empty = F.raise_error(F.lit("both groups need at least one row"))
    target = F.when(F.col("target").isNull() | F.col("baseline").isNull(), empty).otherwise(F.col("target"))
    apart = F.raise_error(F.lit("the groups have equal means, so no direction lies between them"))
    target = F.when(F.col("target") == F.col("baseline"), apart).otherwise(target)
    return both.select(unit_difference(0.0)(target, "baseline").alias("vector"))


def _partial_gram(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """One task's share of XᵀX, the column sums and the row count; NaN and infinity are errors."""
    gram = total = None
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = as_matrix(batch.column(0))
        if gram is None:
            width = x.shape[1]
            if 8 * width**2 > max_bytes:
                raise ValueError(f"a Gram matrix of {width} rows has over {max_bytes} bytes")
            gram, total = np.zeros((width, width)), np.zeros(width)
        if not np.isfinite(x).all():
            raise ValueError("a vector holds NaN or infinity")
        gram += x.T @ x
        total += x.sum(axis=0)
        rows += len(x)
    if gram is not None:
        width = len(total)
        position = np.concatenate([[SUM_ROW], np.arange(width)]).astype(np.int32)
        counts = np.concatenate([[rows], np.zeros(width)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(position), as_lists(np.vstack([total, gram])), pa.array(counts)], ["row_idx", "values", "n_rows"]
        )


def gram_rows(vectors: DataFrame, column: str = "diff", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The Gram matrix XᵀX by rows; row -1 holds the column sums and the row count.

    Every task keeps one square matrix of at most ``max_bytes`` and emits it once, by rows; the
    tasks' rows are added up side by side. The tasks are those of the table as it comes.
    """
    source = vectors.select(column).filter(F.col(column).isNotNull())
    partial = source.mapInArrow(
        lambda batches: _partial_gram(batches, max_bytes), "row_idx INT, values ARRAY<DOUBLE>, n_rows BIGINT"
    )
    return partial.groupBy("row_idx").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("values")))).alias("values"), F.sum("n_rows").alias("n_rows")
    )


def principal_directions(
    diffs: DataFrame,
    k: int,
    center: bool = False,
    prepend_mean: bool = False,
    column: str = "diff",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The top right singular vectors of the difference matrix, at most as many as it has.

    Uncentred by default, with the first direction pointing along the mean. With
    ``prepend_mean`` the unit mean comes first as component 0. Only the square Gram
    matrix reaches the driver, as Arrow columns; its bytes are checked in the tasks.
    """
    if k < 1:
        raise ValueError("k must be positive")
    table = gram_rows(diffs, column, max_bytes).toArrow()
    if not table.num_rows:
        raise ValueError("no vectors to decompose")
    order = np.argsort(table["row_idx"].to_numpy())  # SUM_ROW comes first
    both = as_matrix(table["values"])[order]
    n = int(table["n_rows"].to_numpy()[order[0]])
    mean, gram = both[0] / n, both[1:]
    if center:
        gram = gram - n * np.outer(mean, mean)
    squares, vectors = np.linalg.eigh(gram)
    order = np.argsort(-squares, kind="stable")[: min(k, n, len(mean))]
    singular = np.sqrt(np.maximum(squares, 0.0))
    singular[singular < NOISE * singular.max()] = 0.0
    total = float(np.trace(gram))

    entries = []
    if prepend_mean:
        length = np.linalg.norm(mean)
        entries.append((0, "mean", (mean / length if length else mean).tolist(), None, total))
    for rank, column_idx in enumerate(order):
        axis = vectors[:, column_idx]
        if rank == 0 and not center:
            flip = axis @ mean < 0
        else:
            flip = axis[np.argmax(np.abs(axis))] < 0
        axis = -axis if flip else axis
        entries.append((len(entries), "principal", axis.tolist(), float(singular[column_idx]), total))
    return diffs.sparkSession.createDataFrame(entries, schemas.DIRECTIONS)


def explained_variance(directions: DataFrame) -> DataFrame:
    """Share of all variance per direction, and its running sum; null when there is no variance."""
    share = F.when(F.col("total_variance") >= NO_VARIANCE, F.col("singular_value") ** 2 / F.col("total_variance"))
    # One row per direction.
    running = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    principal = directions.filter(F.col("kind") == "principal").withColumn("share", share)
    return principal.select("component", "share", F.sum("share").over(running).alias("running_share"))


def direction_similarity(vectors: DataFrame) -> DataFrame:
    """Cosine of every two named vectors; the bytes of all of them are checked."""
    others = as_array(vectors.select("name", "vector"), "name")
    pairs = vectors.select("name", "vector", F.explode(others).alias("other"))
    return pairs.select(
        F.col("name").alias("name_a"),
        F.col("other.name").alias("name_b"),
        cosine(F.col("vector"), F.col("other.vector")).alias("cosine"),
    )
