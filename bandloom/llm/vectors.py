"""Vectors as whole numbers: ``floor(scale * x)`` of every component, packed for Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Components beyond the largest 32-bit float count as not finite.
LARGEST = float(np.finfo(np.float32).max)


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite; false for a null vector."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) <= LARGEST, F.lit(False))), F.lit(False))


def clean(df: DataFrame, id_col: str, vector: str, dims: int | None = None) -> DataFrame:
    """``vec_id, vector`` (array of doubles) of the rows whose vector is finite, with ``dims`` components if that is given."""
    v = df[vector].cast("array<double>")
    kept = df.filter(finite(v) if dims is None else finite(v) & (F.size(v) == dims))
    return kept.select(df[id_col].cast("bigint").alias("vec_id"), v.alias("vector"))


def whole(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    """Rows of ``floor(SCALE * x)`` from a list column whose rows all have ``dims`` components.

    Doubles hold these exactly: what is above 2**53 has no fraction.
    """
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(len(batch), dims) * SCALE)


def packed(q: np.ndarray) -> bytes:
    """16-bit integers where they hold all values, doubles elsewhere; the length tells which."""
    small = q.size == 0 or np.abs(q).max() < 2**15
    return np.ascontiguousarray(q, "<i2" if small else "<f8").tobytes()


def unpacked(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = "<i2" if len(data) == 2 * rows * dims else "<f8"
    return np.frombuffer(data, kind).reshape(rows, dims)


def exact(q: np.ndarray, bound: float) -> np.ndarray:
    """The type in which sums and products up to ``bound`` are exact: 32- or 64-bit integers, or Python's integers."""
    if bound < 2**31:
        return q.astype(np.int32)
    if bound < 2**62:
        return q.astype(np.int64)
    out = np.empty(q.shape, object)
    out.ravel()[:] = [int(x) for x in q.ravel()]
    return out
