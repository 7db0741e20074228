"""Integer vectors from embeddings, shared by the operators on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared norms up to which every product and distance fits a long.
LARGEST = float(1 << 60)


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as array<long>; null if the vector is null, has a
    null or non-finite component, or is too long for exact products (LARGEST)."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    real = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    norm = F.aggregate(real, F.lit(0.0), lambda a, x: a + x * x)  # null or NaN if one component is
    return F.when(F.col(vector).isNotNull() & norm.isNotNull() & (norm < F.lit(LARGEST)), scaled)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer rows: in floating point where no sum can leave its exact range."""
    top = [float(np.sqrt(np.square(x.astype(float)).sum(1).max(initial=0))) for x in (a, b)]
    if top[0] * top[1] < 1 << 52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)
