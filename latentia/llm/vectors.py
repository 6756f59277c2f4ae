"""Vectors as rows of arrays: usable ones become unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latentia.session import ship

UNITS = "id long, v array<float>"


def usable(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``dim`` finite values, not all zero, and their unit vectors (float64)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return at, np.zeros((0, dim))
    flat = col.take(pa.array(at)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1)
        ok = np.isfinite(x).all(axis=1) & (top > 0)  # null elements read as NaN
        x, at = x[ok], at[ok]
        x = x / top[ok][:, None]  # magnitudes differ by powers of ten: squares must not vanish
        return at, x / np.sqrt((x * x).sum(axis=1))[:, None]


def as_list(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as list<float>."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(x.astype(np.float32).ravel()))


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list<float> column without nulls as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def units(df: DataFrame, row_id: str, vector: str, dim: int) -> DataFrame:
    """``id, v``: the usable rows as unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column("v"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), as_list(x)], ["id", "v"])

    ship(df.sparkSession)
    return df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, UNITS)
