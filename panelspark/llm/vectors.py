"""Embedding rows as exact integer matrices, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VECTOR = "embedding"


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite components only; the vector becomes array<double>."""
    wide = rows.withColumn(VECTOR, F.col(VECTOR).cast("array<double>"))
    odd = F.exists(VECTOR, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return wide.where(F.col(VECTOR).isNotNull() & ~odd)


def dimension(rows: DataFrame) -> int:
    """Length of the longest vector, 1 at least."""
    return max(rows.agg(F.max(F.size(VECTOR))).first()[0] or 0, 1)


def quantised(col: pa.Array, dim: int, scale: int, bound: int) -> np.ndarray:
    """floor(scale * x) of a list column as int32 (rows x dim).

    A vector shorter than ``dim`` counts as padded with zeros; values beyond ``bound`` stand at it."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    x = np.clip(np.floor(col.flatten().to_numpy(zero_copy_only=False) * scale), -bound, bound).astype(np.int32)
    if (n == dim).all():
        return x.reshape(len(n), dim)
    out = np.zeros((len(n), dim), np.int32)
    first = np.cumsum(n) - n
    out[np.repeat(np.arange(len(n)), n), np.arange(len(x)) - np.repeat(first, n)] = x
    return out


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    flat = np.ascontiguousarray(x)
    width = flat.shape[1] * flat.itemsize
    offsets = pa.py_buffer(np.arange(0, (len(flat) + 1) * width, max(width, 1), dtype=np.int32)[:len(flat) + 1])
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, offsets, pa.py_buffer(flat)])


def unpacked(col: pa.Array, dim: int, kind=np.int32) -> np.ndarray:
    """The matrix of ``packed`` values (all rows of ``dim`` numbers)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.dtype(kind).itemsize * dim
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros((0, dim), kind)
    start = int(np.frombuffer(offs, np.int32, 1, col.offset * 4)[0])
    return np.frombuffer(data, kind, len(col) * dim, start).reshape(len(col), dim) if size else np.zeros((len(col), 0), kind)
