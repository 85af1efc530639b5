"""What the vector operators share: which vectors take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec_id: Column, vector: Column) -> Column:
    """Has an id, all components present and finite, and at least one that isn't zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec_id.isNotNull() & vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """An Arrow list column, all lists of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)
