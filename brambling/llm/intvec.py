"""Vectors as whole numbers: what the integer operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole components below this size, and squared norms up to NORM, keep every sum and product (times 100) exact in 64 bits.
COMPONENT, NORM = float(1 << 26), 1 << 52


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x, taken as a double; null for a vector that is null or empty, or holds a
    component that is null, not finite or too large for exact sums (from 2^26 on after scaling)."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x * scale) < COMPONENT - 1)) & (F.size(v) > 0)
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: F.floor(x * scale).cast("int")))


def squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x.cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length as 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exact: by floating point only where no sum can lose a bit."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T
