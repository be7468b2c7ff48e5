"""Tables of vectors: which rows take part, bounded samples, and NumPy matrices of batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.batches import bounded


def usable(df: DataFrame, vector: str, key: str) -> tuple[DataFrame, int]:
    """``id, vec`` of the rows that take part, and the vectors' length.

    Left out are rows without id, and vectors that are null, zero, hold null or non-finite components, or are
    not of the most frequent length (the longest of equally frequent ones).
    """
    vec = F.col(vector).cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) \
        & F.exists(vec, lambda x: x != 0.0)
    rows = bounded(df).select(F.col(key).cast("long").alias("id"), vec.alias("vec")) \
        .filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")) \
        .orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    length = sizes[0]["size"] if sizes else 1
    return rows.filter(F.size("vec") == length), length


def matrix(column: pa.Array, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), length)


def lists(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] if rows.ndim == 2 else 1
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, size, dtype=np.int32)), pa.array(rows.ravel()))


def sample(rows: DataFrame, length: int, most: int) -> np.ndarray:
    """At most ``most`` vectors, those of the smallest hashes of their ids: the same on every run."""
    found = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toArrow()
    return matrix(found["vec"], length) if found.num_rows else np.zeros((0, length))
