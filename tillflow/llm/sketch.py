"""Merged count sketches: fixed-size flags that never miss a hash seen often enough.

Every task counts its hashes in ``DEPTH`` rows of 2**``WIDTH_BITS`` saturating cells and sends the cells it
used; blocks of cells are added up in two rounds, so no reducer gets more than a bounded part. What returns to
the driver is one bit per cell, 4 MB in all, whatever the input's size. A hash counts as at most the smallest of
its cells, and its cells hold at least its own count: collisions let more hashes through, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.units import MASK, U64, mix

WIDTH_BITS, DEPTH = 24, 2
BLOCK_BITS = 16
BLOCKS = DEPTH << WIDTH_BITS - BLOCK_BITS
#: Partial sketches of a block are first merged in this many groups.
MERGE_GROUPS = 64
_SCHEMA = "block int, cells binary, counts binary"


def _cells(hashes: np.ndarray, row: int) -> np.ndarray:
    seed = U64(0x5851F42D4C957F2D * (row + 1) & MASK)
    return (mix(hashes ^ seed) >> U64(64 - WIDTH_BITS)).astype(np.int64)


def _count(hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((DEPTH, 1 << WIDTH_BITS), np.uint8)
        for batch in batches:
            for some in hashes(batch):
                for row in range(DEPTH):
                    cell, times = np.unique(_cells(some, row), return_counts=True)
                    counts[row, cell] = np.minimum(counts[row, cell] + times, 255)
        flat = counts.reshape(BLOCKS, 1 << BLOCK_BITS)
        for first in range(0, BLOCKS, 64):
            used = [(block, np.flatnonzero(flat[block])) for block in range(first, first + 64)]
            used = [(block, cell) for block, cell in used if len(cell)]
            if used:
                yield _batch([b for b, _ in used], [c for _, c in used], [flat[b][c] for b, c in used])
    return run


def _batch(blocks: list[int], cells: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(blocks, pa.int32()), pa.array([c.astype(np.uint16).tobytes() for c in cells], pa.binary()),
        pa.array([c.astype(np.uint8).tobytes() for c in counts], pa.binary())], names=["block", "cells", "counts"])


def _total(table: pa.Table) -> np.ndarray:
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for cells, counts in zip(table["cells"].to_pylist(), table["counts"].to_pylist()):
        total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint8)
    return np.minimum(total, 255)


def _merge(table: pa.Table) -> pa.Table:
    total = _total(table)
    cell = np.flatnonzero(total)
    return pa.Table.from_batches([_batch(table["block"].slice(0, 1).to_pylist(), [cell], [total[cell]])])


def _flags(table: pa.Table, least: int) -> pa.Table:
    return pa.table({"block": table["block"].slice(0, 1).combine_chunks(),
                     "flags": pa.array([np.packbits(_total(table) >= least).tobytes()])})


def flags(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], least: int) -> np.ndarray:
    """One bit per cell: those that the 64-bit hashes of all batches of ``df`` hit ``least`` times or more."""
    parts = df.mapInArrow(_count(hashes), _SCHEMA) \
        .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    merged = parts.groupBy("block", "part").applyInArrow(_merge, _SCHEMA)
    rows = merged.groupBy("block").applyInArrow(lambda t: _flags(t, least), "block int, flags binary").collect()
    bits = np.zeros((BLOCKS, 1 << BLOCK_BITS - 3), np.uint8)
    for row in rows:
        bits[row["block"]] = np.frombuffer(row["flags"], np.uint8)
    return bits.reshape(DEPTH, -1)


def column_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The first column, of 64-bit hashes, as :func:`flags` takes it."""
    yield batch.column(0).to_numpy().view(U64)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` have all their cells flagged."""
    out = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        cell = _cells(hashes, row)
        out &= (bits[row][cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
    return out
