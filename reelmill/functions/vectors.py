"""Vector expressions and the Arrow/numpy helpers used inside block tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_blob(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array; NULL when empty or of broken length."""
    return blob.map(lambda b: np.frombuffer(b, dtype="<f4") if b and len(b) % 4 == 0 else None)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit vector as doubles; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def unit_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column to a float64 matrix with rows of length 1 (zero rows kept)."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    rows = len(lists)
    if len({*lists.value_lengths().to_pylist()}) > 1:
        raise ValueError("vectors of different dimensions")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(rows, -1)
    size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(size > 0, size, 1.0)


def id_array(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    whole = lists.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    return whole.value_lengths().to_numpy(zero_copy_only=False), whole.flatten().to_numpy(zero_copy_only=False)


def stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of stretches of the given starts and lengths, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
