"""Vector arithmetic.

Dot products and norms are built-in higher-order functions. Anything that divides or
shifts every element by a value derived from the whole vector is an Arrow UDF: Catalyst
inlines the derived value into the per-element lambda, which makes the work quadratic
in the vector length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_matrix(vectors: pa.Array) -> np.ndarray:
    """An Arrow list column as a float64 matrix; null vectors and vectors of unequal length are errors."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.zeros((0, 0))
    if vectors.null_count:
        raise ValueError("a vector is null")
    widths = vectors.value_lengths().to_numpy()
    if (widths != widths[0]).any():
        raise ValueError(f"vectors of {widths.min()} and of {widths.max()} entries")
    flat = vectors.flatten()
    if flat.null_count:
        raise ValueError("an entry of a vector is null")
    return flat.to_numpy(zero_copy_only=False).reshape(len(vectors), widths[0]).astype(np.float64)


def each_vector(vectors: pa.Array, change: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """``change`` applied to the matrix of the vectors that are not null; null stays null."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not vectors.null_count:
        return as_lists(change(as_matrix(vectors)))
    there = vectors.is_valid()
    changed = as_lists(change(as_matrix(vectors.filter(there)))) if vectors.null_count < len(vectors) else None
    places = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
    if changed is None:
        return pa.nulls(len(vectors), pa.list_(pa.float64()))
    return changed.take(pa.array(places, mask=~there.to_numpy(zero_copy_only=False)))


def as_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel(), type=pa.float64()))


def unit_rows(matrix: np.ndarray, epsilon: float) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + epsilon)


def unit_difference(epsilon: float) -> Callable[..., Column]:
    """``(a, b) -> (a - b) / (|a - b| + epsilon)``; equal vectors give the zero vector."""

    @F.arrow_udf("array<double>")
    def difference(left: pa.Array, right: pa.Array) -> pa.Array:
        return as_lists(unit_rows(as_matrix(left) - as_matrix(right), epsilon))

    return difference


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, product: total + product)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Null when one side has no length."""
    return F.try_divide(dot(left, right), norm(left) * norm(right))
