"""Which rows of a vector table take part in a search, and blocks of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ok, F.lit(False))


def matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """A (rows, dim) matrix of a list column whose lists all have dim values."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), dim)


def dims(df: DataFrame, vec_col: str) -> list[int]:
    """The vector lengths that occur, few in any table. Vectors of different lengths have no inner product."""
    return sorted(r[0] for r in df.select(F.size(vec_col).alias("d")).distinct().collect())
