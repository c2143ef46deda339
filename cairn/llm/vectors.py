"""Vectors as integers: which rows take part in an operator, and their components as floors of multiples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(v: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(v: Column, scale: int, held: int) -> Column:
    """floor(scale * x) of each component as longs; beyond `held` in either direction they are held there."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(held))), F.lit(float(-held)))))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch, all of dims components, as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
