"""Singular directions of vector tables without a square matrix: QR merged as a tree, and a range finder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens import schemas
from formlens.functions.vectors import as_lists, as_matrix
from formlens.sources.tables import stored

DIRECT_WIDTH = 1_024
OVERSAMPLING = 10
ROUNDS = 6
FAN_IN = 16
SEED = 24
MAX_BYTES = 2 << 30
BATCH_BYTES = 32 << 20
TINY = 1e-13

FACTORS = "node BIGINT, part BIGINT, row_idx INT, values ARRAY<DOUBLE>"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            x = as_matrix(batch.column(0))
            if not np.isfinite(x).all():
                raise ValueError("a vector holds NaN or infinity")
            yield x


def _rows(node: int, part: int, factor: np.ndarray) -> pa.RecordBatch:
    n = len(factor)
    arrays = [pa.array(np.full(n, node)), pa.array(np.full(n, part)), pa.array(np.arange(n, dtype=np.int32)), as_lists(factor)]
    return pa.RecordBatch.from_arrays(arrays, ["node", "part", "row_idx", "values"])


def _reduced(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of ``rows``, which has their singular values and right singular vectors."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def tree_factor(vectors: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The triangular factor R of the matrix of all rows ``change(x)``, at most as many rows as columns.

    Every task folds its batches into one factor. Sixteen factors at a time are stacked and factored again,
    level by level in a table, until one is left, which alone reaches the driver. Nothing is squared, so small
    singular values keep their digits.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = None
        for x in _matrices(batches):
            y = change(x)
            factor = _reduced(y if factor is None else np.vstack([factor, y]))
        if factor is not None:
            part = TaskContext.get().partitionId()
            yield _rows(part // FAN_IN, part, factor)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("row_idx", "ascending")])
        node = table["node"][0].as_py()
        return pa.Table.from_batches([_rows(node // FAN_IN, node, _reduced(as_matrix(table["values"])))])

    level = stored(vectors.mapInArrow(fold, FACTORS), "factors")
    n_tasks = 1 + (level.agg(F.max("part")).first()[0] or 0)
    while n_tasks > 1:
        level = stored(level.groupBy("node").applyInArrow(merge, FACTORS), "factors")
        n_tasks = -(-n_tasks // FAN_IN)
    table = level.toArrow().sort_by("row_idx")
    return as_matrix(table["values"]) if table.num_rows else np.zeros((0, 0))


def _image(vectors: DataFrame, change: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum over all batches of ``aᵀ b`` for ``(a, b) = change(x)``; tasks hand on one such matrix each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches):
            a, b = change(x)
            total = a.T @ b if total is None else total + a.T @ b
        if total is not None:
            yield _rows(0, 0, total)

    summed = vectors.mapInArrow(add, FACTORS).groupBy("row_idx").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("values")))).alias("values")
    )
    return as_matrix(summed.toArrow().sort_by("row_idx")["values"])


def singular_directions(
    diffs: DataFrame,
    k: int,
    center: bool = False,
    prepend_mean: bool = False,
    column: str = "diff",
    rounds: int = ROUNDS,
    direct_width: int = DIRECT_WIDTH,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The top right singular vectors of the difference matrix, as ``principal_directions`` has them.

    Vectors of up to ``direct_width`` entries go through the tree as they are: the result is that of a
    singular value decomposition of the whole matrix, also for values far below 1e-8 of the largest.
    Wider ones are first cut down to ``k + 10`` columns by a random range finder: ``rounds`` times the columns are
    multiplied by the matrix and its transpose, orthonormal in between. Tasks then hand on and merge
    ``(k + 10) x width`` numbers at most, and that is all that reaches the driver; its bytes are checked. The
    leading directions come out the better the more their values stand out; with as many columns as
    the matrix has rank they are exact.

    Null vectors are left out; no vectors, unequal lengths, NaN and infinity are errors.
    """
    if k < 1:
        raise ValueError("k must be positive")
    diffs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    source = diffs.select(column).filter(F.col(column).isNotNull())
    # One narrow pass: width, number, sums and squares.
    sums = source.select(F.size(column).alias("width"), array_to_vector(column).alias("x"), F.aggregate(
        F.transform(column, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x
    ).alias("squares"))
    found = sums.agg(
        F.max("width").alias("width"), F.min("width").alias("least"), F.count("*").alias("n"), F.sum("squares").alias("squares"),
    ).first()
    n, width = found["n"], found["width"]
    if not n:
        raise ValueError("no vectors to decompose")
    if found["least"] != width:
        raise ValueError(f"vectors of {found['least']} and of {width} entries")
    n_columns = min(k + OVERSAMPLING, n, width) if width > direct_width else width
    if 8 * n_columns * width > max_bytes:
        raise ValueError(f"{n_columns} vectors of {width} entries have over {max_bytes} bytes")
    mean = np.array(sums.agg(vector_to_array(Summarizer.mean(F.col("x"))).alias("mean")).first()["mean"])
    shift = mean if center else 0.0
    total = float(found["squares"]) - (n * float(mean @ mean) if center else 0.0)

    if n_columns == width:
        basis = None
        factor = tree_factor(source, lambda x: x - shift)
    else:
        basis, _ = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, n_columns)))
        for _ in range(rounds):
            held = basis
            factor = tree_factor(source, lambda x, held=held: (x - shift) @ held)
            _, values, turn = np.linalg.svd(factor, full_matrices=False)
            # Columns of unit length, where the matrix has such; the others stay as they are.
            scale = turn.T / np.where(values > TINY * max(values[0], 1e-300), values, 1.0)
            image = _image(source, lambda x, held=held, scale=scale: ((x - shift) @ held @ scale, x - shift))
            basis, _ = np.linalg.qr(image.T)
        factor = tree_factor(source, lambda x, held=basis: (x - shift) @ held)
    _, values, axes = np.linalg.svd(factor, full_matrices=False)
    axes = axes if basis is None else axes @ basis.T

    entries = []
    if prepend_mean:
        length = np.linalg.norm(mean)
        entries.append((0, "mean", (mean / length if length else mean).tolist(), None, total))
    for rank, axis in enumerate(axes[: min(k, n)]):
        flip = axis @ mean < 0 if rank == 0 and not center else axis[np.argmax(np.abs(axis))] < 0
        entries.append((len(entries), "principal", (-axis if flip else axis).tolist(), float(values[rank]), total))
    return diffs.sparkSession.createDataFrame(entries, schemas.DIRECTIONS)
