"""Vectors of whole numbers, and bounded blocks of queries that are asked against all rows.

``whole_vectors`` scales every component and takes its floor, so that inner products are exact. ``shape_of`` is one pass for the
number of rows, the widest vector and the largest squared length, which tells how scores can be summed exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Squared length up to which sums of doubles are exact, and from which on scores needn't fit a long.
EXACT_DOUBLE, LARGEST = float(1 << 53), float(1 << 60)


@dataclass(frozen=True)
class Shape:
    rows: int
    width: int
    largest: float

    @property
    def dtype(self) -> type:
        return np.float64 if self.largest < EXACT_DOUBLE else np.int64


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, *more: Column) -> DataFrame:
    """id, v (floor(scale * x) of each component x as a double) and more columns; rows without id or usable vector are left out."""
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(scale * x.cast("double")))
    length = F.aggregate(F.col(vector_col), F.lit(0.0), lambda a, x: a + F.pow(F.abs(scale * x.cast("double")) + 1, F.lit(2.0)))
    return rows.select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"), length.alias("length"), *more)


def shape_of(rows: DataFrame) -> Shape:
    """Of the rows of whole_vectors; the squared length is a bound on the true one."""
    got = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max("length").alias("largest")).first()
    if got.largest is not None and not got.largest < LARGEST:
        raise ValueError("inner products of these vectors don't fit a long")
    return Shape(got.n, got.width or 0, got.largest or 0.0)


def matrix(column: pa.Array, shape: Shape) -> np.ndarray:
    """A row for each vector; shorter ones are padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(shape.dtype)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == shape.width).all():
        return flat.reshape(len(sizes), shape.width)
    out = np.zeros((len(sizes), shape.width), shape.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, as whole numbers."""
    return (a @ b.T).astype(np.int64)
