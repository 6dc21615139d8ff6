"""Vector columns inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm import by_value

by_value(__name__)


def usable(column: str = "embedding"):
    """True for vectors that have components, none of them null or non-finite, and not all zero."""
    v = F.col(column)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def one_per_id(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, raw): usable vectors as little-endian doubles, one for each id (of several, the smallest as bytes)."""
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            at = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.cast(pa.float64()).to_numpy()
            rows = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.diff(at)), pa.array(rows, pa.binary())], ["vec_id", "dim", "raw"])

    whole = vectors.where(usable()).where("vec_id IS NOT NULL").select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim long, raw binary")
    return whole.groupBy("vec_id").agg(F.min(F.struct("raw", "dim")).alias("v")).select("vec_id", "v.dim", "v.raw")


def matrix(table: pa.Table, dim: int) -> np.ndarray:
    """The ``raw`` column of a table as rows of doubles."""
    return np.frombuffer(b"".join(table["raw"].to_pylist()), np.float64).reshape(-1, dim)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows or vanishes and every cosine stays the same to the bit."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1]) if len(rows) else rows
