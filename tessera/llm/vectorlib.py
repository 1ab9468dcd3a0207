"""Integer vectors shared by clustering and mining: exact products and the rows that take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Components stay below this: 64 squared differences then fit a long.
LIMIT = 2**27


def usable(vector: Column) -> Column:
    """Whether a vector has components, each of them there, finite and below ``LIMIT`` once it is an integer."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.abs(x) < LIMIT // SCALE), F.lit(False))


def integers(column: pa.Array) -> np.ndarray:
    """Usable vectors of equal length as a matrix of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices, exact: in floats where no sum can leave their 53 bits, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
