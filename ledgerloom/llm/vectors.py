"""Vectors as whole numbers: which rows take part, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers are bounded so; far beyond what any embedding holds.
LARGEST = float(1 << 62)


def whole(vector: Column, shift: int = 0) -> Column:
    """floor(1024 * c) + ``shift`` of every component, as long; null for a vector that is null or holds null or non-finite components.

    Components of 2^52 and more in size count as 2^52.
    """
    v = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(fine, F.transform(v, lambda c: F.floor(F.greatest(F.least(c * 1024, F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(shift)))


def whole_vectors(df: DataFrame, shift: int = 0) -> DataFrame:
    """vec_id, x of the rows whose vector takes part. Other columns are not read."""
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), shift).alias("x")).where("x is not null")


def matrix(column: pa.Array, dims: int, pad: int = 0) -> np.ndarray:
    """The vectors of an Arrow list array, one a row; shorter ones end in ``pad``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (lengths == dims).all():
        return flat.reshape(len(column), dims)
    out = np.full((len(column), dims), pad, np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out
