"""Embedding columns as exact integers, for the operators that compare vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers must be smaller than this, so that squared distances of 64 components fit 64 bits.
MOST = 1 << 27


def usable(column: str, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none of them null or non-finite; a null vector isn't usable."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(column) == dims) & ~bad, F.lit(False))


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and floor(scale * x) of their components (rows by ``dims``), x as a double.

    A finite component of ``MOST / scale`` or more in size is an error: its distances don't fit 64 bits.
    """
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    rows = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    x = column.filter(sized).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(x).all(axis=1)
    x = np.floor(x[finite] * float(scale))
    if len(x) and not np.abs(x).max() < MOST:
        raise ValueError(f"a component is {MOST // scale} or more in size")
    return rows[finite], x.astype(np.int64)


def first_vectors(df: DataFrame, column: str, order: list[Column], n: int, dims: int, scale: int) -> np.ndarray:
    """The integers of the ``n`` usable vectors that come first in this order (of equal ones, the smaller vector)."""
    rows = df.filter(usable(column, dims)).orderBy(*order, column).select(column).limit(n).collect()
    return integers(pa.array([r[0] for r in rows], pa.list_(pa.float64())), dims, scale)[1]
