"""Joins of rows with lookups that are unique by key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def left_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``rows`` with ``lookup``, a stored table that is unique on ``keys``.

    One plan at every size: Spark broadcasts the lookup if its stored bytes allow it. Otherwise both sides are
    shuffled by key, and adaptive execution splits the partitions of hot keys, null among them, since every key
    has one lookup row at most.
    """
    values = [c for c in lookup.columns if c not in keys]
    return rows.join(lookup, keys, "left").select(*rows.columns, *values)


def file_lookup(rows: DataFrame, per_file: DataFrame) -> DataFrame:
    """Attach a table with one row per file."""
    return left_lookup(rows, per_file, ["file"])
