"""Row numbers of a whole table or of large groups, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.operators.skew import left_lookup
from tillflow.session import materialise


def with_rank(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``rows`` with their number from 0 in ``order``, within groups of ``by`` (not null) where given.

    A range shuffle sorts the rows, each part numbers its own, and the rows of earlier parts are added: one count
    per part and group. Rows that agree on all of ``order`` are numbered in no particular way among themselves.
    """
    by = by or []
    placed = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order) \
        .withColumn("_place", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_place", 33)), "placed")
    heads = placed.groupBy(*by, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(heads.select(
        *by, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset")), "offsets")
    return left_lookup(placed, offsets, [*by, "_part"]).withColumn(name, F.col("_place") + F.col("_offset")) \
        .drop("_place", "_part", "_offset")
