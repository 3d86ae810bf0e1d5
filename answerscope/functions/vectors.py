"""Dense vector maths on array columns, as Arrow UDFs over whole batches.

Higher-order functions run interpreted, which is too slow at thousands of
dimensions; a batch here is one matrix and one call.  NULL in gives NULL out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def as_matrix(column: pa.Array, keep: np.ndarray | None = None) -> np.ndarray:
    """Rows of a list array as a float64 matrix; only those in ``keep``, which must not be NULL."""
    if keep is not None:
        column = column.filter(pa.array(keep))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if column.null_count or (len(column) and len(flat) % len(column)) or len(set(pc.list_value_length(column).unique().to_pylist())) > 1:
        raise ValueError("vectors of one batch must have one width")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def as_lists(matrix: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    """A float64 matrix as a list array; with ``keep``, its rows go where that is set and the others are NULL."""
    rows, width = matrix.shape if matrix.size else (len(matrix), 0)
    keep = np.ones(rows, dtype=bool) if keep is None else keep
    offsets = np.zeros(len(keep) + 1, dtype=np.int32)
    np.cumsum(keep * width, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()), mask=pa.array(~keep))


def valid(*columns: pa.Array) -> np.ndarray:
    """Which rows have a value in every column."""
    out = np.ones(len(columns[0]), dtype=bool)
    for c in columns:
        out &= c.is_valid().to_numpy(zero_copy_only=False)
    return out


def numbers(values: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Values of the rows in ``keep``, NULL for the others."""
    out = np.zeros(len(keep))
    out[keep] = values
    return pa.array(out, mask=~keep)


def _scalars(column: pa.Array, keep: np.ndarray) -> np.ndarray:
    return column.filter(pa.array(keep)).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]


@F.arrow_udf(DoubleType())
def dot(left: pa.Array, right: pa.Array) -> pa.Array:
    keep = valid(left, right)
    return numbers(np.einsum("ij,ij->i", as_matrix(left, keep), as_matrix(right, keep)), keep)


@F.arrow_udf(DoubleType())
def norm(vectors: pa.Array) -> pa.Array:
    keep = valid(vectors)
    m = as_matrix(vectors, keep)
    return numbers(np.sqrt(np.einsum("ij,ij->i", m, m)), keep)


@F.arrow_udf(DoubleType())
def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    keep = valid(left, right)
    a, b = as_matrix(left, keep), as_matrix(right, keep)
    size = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    some = size > 0
    value = np.einsum("ij,ij->i", a, b)[some] / size[some]
    keep[keep] = some
    return numbers(value, keep)


@F.arrow_udf(DoubleType())
def distance(left: pa.Array, right: pa.Array) -> pa.Array:
    keep = valid(left, right)
    gap = as_matrix(left, keep) - as_matrix(right, keep)
    return numbers(np.sqrt(np.einsum("ij,ij->i", gap, gap)), keep)


@F.arrow_udf(ArrayType(DoubleType()))
def subtract(left: pa.Array, right: pa.Array) -> pa.Array:
    keep = valid(left, right)
    return as_lists(as_matrix(left, keep) - as_matrix(right, keep), keep)


@F.arrow_udf(ArrayType(DoubleType()))
def add_scaled(base: pa.Array, direction: pa.Array, scale: pa.Array) -> pa.Array:
    """base + scale * direction."""
    keep = valid(base, direction, scale)
    return as_lists(as_matrix(base, keep) + _scalars(scale, keep) * as_matrix(direction, keep), keep)


@F.arrow_udf(ArrayType(DoubleType()))
def scale_by(vectors: pa.Array, scale: pa.Array) -> pa.Array:
    keep = valid(vectors, scale)
    return as_lists(as_matrix(vectors, keep) * _scalars(scale, keep), keep)


@F.arrow_udf(ArrayType(DoubleType()))
def unit(vectors: pa.Array) -> pa.Array:
    keep = valid(vectors)
    m = as_matrix(vectors, keep)
    size = np.sqrt(np.einsum("ij,ij->i", m, m))
    return as_lists(m / np.where(size == 0, 1.0, size)[:, None], keep)
