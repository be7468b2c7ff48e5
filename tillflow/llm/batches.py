"""Bounded Arrow batches for tables of long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes after which Spark closes a batch for a Python task; ten thousand long texts would not fit beside others.
BATCH_BYTES = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches were bounded by bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df
