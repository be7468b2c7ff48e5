"""N-gram Jaccard join: exact links of similar documents by pivots, regions and triangle-inequality windows.

Documents are sets of word shingles, and Jaccard distance is a metric. Two linked sets share a shingle among the
first few of each in any common order, so each such shingle is a cell that holds all its possible links. The
order puts shingles that a merged sketch finds frequent last, which keeps cells small.

Every cell takes the member with the smallest hash as its pivot. Members within the limiting distance of the
pivot are its region: all linked to it, so their links with each other add nothing to a component. By the
triangle inequality a member of the region can link to one outside only if their distances to the pivot differ
by no more than the limit; members in that window are replicated to the rest of the cell, which is joined again
around a new pivot. After ``ROUNDS`` pivots, what is left of a cell is compared in blocks. Counts of shingles by
hash bound distances from below, so sets are only sent for pairs that may be near.

Equal sets are one class from the start. Nothing is sampled or capped: cells of any size are split by pivots and
blocks, and components come from links to pivots, not from all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.batches import bounded
from tillflow.llm.graph import components
from tillflow.llm.sketch import flags, holds
from tillflow.llm.units import BASES, LOWER, PLAIN, U64, mix, prefix, rows_of, signed, slices, span, word_bounds, word_hashes
from tillflow.session import materialise

#: Cells of the frequency sketch, 4 MB of levels when sent to the tasks, and of a class's count vector.
LEVEL_BITS, VECTOR = 22, 256
BLOCK_BITS, MERGE_GROUPS = 16, 64
#: Pivots per cell before its rest is compared in blocks of this many classes.
ROUNDS, BLOCK = 2, 1024
LAST = (1 << 63) - 1


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first, bounds, shingles)`` of consecutive rows: each text's distinct shingles as sorted hashes.

    A text of fewer than ``size`` words has its whole sequence as one shingle, a text without words none.
    """
    for first, _, data, offsets in slices(texts):
        lowered = LOWER[data]
        starts, ends, word_at = word_bounds(lowered, offsets, PLAIN)
        words = word_hashes(lowered, starts, ends)
        sums = prefix(words, BASES[0])
        count = np.diff(word_at)
        place = np.arange(max(0, len(words) - size + 1))
        row = rows_of(word_at)
        whole = place[place + size <= word_at[1:][row[:len(place)]]]
        short = np.flatnonzero((count > 0) & (count < size))
        row = np.concatenate([row[whole], short])
        shingles = np.concatenate([span(sums, whole, whole + size, BASES[0]),
                                   mix(span(sums, word_at[short], word_at[short + 1], BASES[0])
                                       ^ mix(count[short].astype(U64)))])
        order = np.lexsort((shingles, row))
        row, shingles = row[order], shingles[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])
        row, shingles = row[new], shingles[new]
        yield first, np.searchsorted(row, np.arange(len(offsets))), shingles


def class_ids(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order; empty sets get 0."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(shingles ^ U64(BASES[1])), dtype=U64)])
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    return np.where(np.diff(bounds) > 0, mix(total + np.diff(bounds).astype(U64)), U64(0))


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) >> U64(64 - LEVEL_BITS)).astype(np.int64)


def levels(texts: DataFrame, size: int) -> np.ndarray:
    """For each sketch cell, how much more often than a usual one it was hit, as a power of two.

    Counts stay in the tasks: the driver gets their sum and one byte per cell.
    """
    blocks, summed = "block int, counts binary", "block int, counts binary, hits long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << LEVEL_BITS, np.uint8)
        for batch in batches:
            for _, _, shingles in shingle_sets(batch.column(0), size):
                cell, times = np.unique(_cell(shingles), return_counts=True)
                counts[cell] = np.minimum(counts[cell] + times, 255)
        for number, block in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([block.tobytes()], pa.binary())],
                                             names=["block", "counts"])

    def merge(kind_in: type, table: pa.Table, sums: bool) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for counts in table["counts"].to_pylist():
            total += np.frombuffer(counts, kind_in)
        merged = {"block": table["block"].slice(0, 1).combine_chunks(), "counts": pa.array([total.tobytes()])}
        return pa.table(merged | ({"hits": pa.array([int(total.sum())])} if sums else {}))

    parts = texts.select("text").mapInArrow(count, blocks) \
        .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    merged = materialise(parts.groupBy("block", "part").applyInArrow(lambda t: merge(np.uint8, t, False), blocks)
                         .groupBy("block").applyInArrow(lambda t: merge(np.int64, t, True), summed), "counts")
    mean = (merged.agg(F.sum("hits")).first()[0] or 0) / (1 << LEVEL_BITS)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                over = np.maximum(np.frombuffer(counts.as_buffer(), np.int64) - mean, 0)
                level = np.log2(1 + over / (1 + 2 * np.sqrt(mean))).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())],
                                                 names=["block", "level"])

    out = np.zeros((1 << LEVEL_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint8)
    for row in merged.select("block", "counts").mapInArrow(rate, "block int, level binary").collect():
        out[row["block"]] = np.frombuffer(row["level"], np.uint8)
    return out.ravel()


def vector_counts(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Per set, how many shingles fall into each of ``VECTOR`` classes, at most 255: distances only shrink."""
    rows = len(bounds) - 1
    spot = rows_of(bounds) * VECTOR + (mix(shingles ^ U64(0x51)) % U64(VECTOR)).astype(np.int64)
    return np.minimum(np.bincount(spot, minlength=rows * VECTOR), 255).astype(np.uint8).reshape(rows, VECTOR)


def _distances(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """Jaccard distances of pairs of sets, given as their sorted shingles."""
    out = np.ones(len(one))
    for n, (a, b) in enumerate(zip(one, other)):
        joined = np.frombuffer(a + b, U64).copy()
        joined.sort(kind="stable")
        both = int((joined[1:] == joined[:-1]).sum())
        out[n] = 1 - both / (len(joined) - both)
    return out


def _named(classes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Names one row of each class, the one with the smallest id."""
    return mix(classes ^ mix(ids))


def _named_columns(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield _named(batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy().view(U64))


class Sets:
    """Where the sets of classes come from: their texts are read again for those that are asked for.

    ``rows`` names the classes of all texts. The text of a class that has the smallest id is found by flags of
    hashed names, so texts are never shuffled.
    """

    def __init__(self, texts: DataFrame, rows: DataFrame, size: int):
        self.texts, self.rows, self.size = texts, rows, size

    def _read(self, classes: DataFrame, schema: str, row_of: Callable) -> DataFrame:
        ones = self.rows.join(classes, "class").groupBy("class").agg(F.min(F.coalesce("id", F.lit(LAST))).alias("one"))
        chosen = self.texts.sparkSession.sparkContext.broadcast(flags(ones, _named_columns, 1))
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given = batch.column(0).fill_null(LAST).to_numpy().view(U64)
                for first, bounds, shingles in shingle_sets(batch.column(1), size):
                    ids = class_ids(bounds, shingles)
                    some = np.flatnonzero(holds(chosen.value, _named(ids, given[first:first + len(ids)])))
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(signed(ids[some])), *row_of(some, bounds, shingles)],
                            names=["class", *schema.replace(",", "").split()[::2]])

        found = self.texts.mapInArrow(run, f"class long, {schema}")
        return found.join(classes, "class", "left_semi").dropDuplicates(["class"])

    def whole(self, classes: DataFrame) -> DataFrame:
        """``class, set`` with the sorted shingles."""
        def row_of(some: np.ndarray, bounds: np.ndarray, shingles: np.ndarray) -> list[pa.Array]:
            return [pa.array([shingles[bounds[r]:bounds[r + 1]].tobytes() for r in some], pa.binary())]

        return materialise(self._read(classes, "set binary", row_of), "sets")

    def counted(self, classes: DataFrame) -> DataFrame:
        """``class, size, vector`` with the counts of shingles by hash."""
        def row_of(some: np.ndarray, bounds: np.ndarray, shingles: np.ndarray) -> list[pa.Array]:
            vectors = vector_counts(bounds, shingles)
            return [pa.array(np.diff(bounds)[some]), pa.array([vectors[r].tobytes() for r in some], pa.binary())]

        return materialise(self._read(classes, "size long, vector binary", row_of), "vectors")


def measured(pairs: DataFrame, light: DataFrame, sets: Sets, far: float) -> DataFrame:
    """``a, b, distance`` of the pairs of classes that their count vectors leave within ``far``; others are not."""

    @F.arrow_udf("boolean")
    def near(one: pa.Array, other: pa.Array, size: pa.Array, other_size: pa.Array) -> pa.Array:
        if not len(one):
            return pa.array([], pa.bool_())
        left, right = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, VECTOR).astype(np.int16)
                       for v in (one, other))
        total = size.to_numpy() + other_size.to_numpy()
        return pa.array(np.abs(left - right).sum(axis=1) <= far / (2 - far) * total + 1e-6)

    @F.arrow_udf("double")
    def distance(one: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array(_distances(one.to_pylist(), other.to_pylist()), pa.float64())

    a, b = (light.select(F.col("class").alias(c), F.col("vector").alias(f"{c}_vector"), F.col("size").alias(f"{c}_size"))
            for c in "ab")
    close = materialise(pairs.join(a, "a").join(b, "b").filter(near("a_vector", "b_vector", "a_size", "b_size"))
                        .select("a", "b"), "near")
    whole = sets.whole(close.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    a, b = (whole.select(F.col("class").alias(c), F.col("set").alias(f"{c}_set")) for c in "ab")
    return close.join(a, "a").join(b, "b").select("a", "b", distance("a_set", "b_set").alias("distance"))


def _near(table: pa.Table, apart: float) -> pa.Table:
    """Pairs of classes of one cell and pair of blocks whose count vectors leave them near enough."""
    ids, own, sizes, roots = (table[c].to_numpy() for c in ("class", "own", "size", "root"))
    low, high = int(table["low"][0].as_py()), int(table["high"][0].as_py())
    vectors = np.frombuffer(b"".join(table["vector"].to_pylist()), np.uint8).reshape(-1, VECTOR).astype(np.int16)
    right = np.flatnonzero(own == high)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for one in np.flatnonzero(own == low):
        other = right[ids[right] > ids[one]] if low == high else right
        other = other[roots[other] != roots[one]]
        other = other[np.abs(vectors[other] - vectors[one]).sum(axis=1) <= apart * (sizes[other] + sizes[one]) + 1e-6]
        out_a.append(np.full(len(other), ids[one]))
        out_b.append(ids[other])
    return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def rest_pairs(members: DataFrame, light: DataFrame, limit: float) -> DataFrame:
    """``a, b``: pairs of classes that share a cell and may be within ``limit``; equal cells are compared once.

    ``members`` has ``cell, class, root``; classes of one root are connected already and not compared.
    """
    cells = members.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("class").alias("least"), F.max("class").alias("most"),
        F.bit_xor(F.xxhash64("class")).alias("mixed"),
        F.min("root").alias("one"), F.max("root").alias("other")).filter("one < other")
    cells = cells.groupBy("n", "least", "most", "mixed").agg(F.min("cell").alias("cell")) \
        .select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(cells, "cell").join(light, "class") \
        .withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    return placed.groupBy("cell", "low", "high").applyInArrow(
        lambda t: _near(t, limit / (2 - limit)), "a long, b long").distinct()


def linked_classes(sigs: DataFrame, light: DataFrame, sets: Sets, limit: float) -> DataFrame:
    """``a, b``: links that connect all linked classes, from ``cell, class`` of every class's first shingles."""
    members, links = sigs, []
    for _ in range(ROUNDS):
        pivots = members.groupBy("cell").agg(F.min("class").alias("pivot"), F.max("class").alias("other")) \
            .filter("pivot < other").select("cell", "pivot")
        around = materialise(members.join(pivots, "cell").filter("class > pivot"), "cells")
        found = materialise(measured(around.select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct(),
                                     light, sets, 2 * limit), "distances")
        links.append(found.filter(F.col("distance") <= limit + 1e-9).select("a", "b"))
        known = around.join(found.select(F.col("a").alias("class"), F.col("b").alias("pivot"), "distance"),
                            ["class", "pivot"], "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))
        # Outside the region all stay; of the region, those that reach the nearest one outside.
        outside = F.col("distance") > limit + 1e-9
        edge = known.groupBy("cell").agg(F.min(F.when(outside, F.col("distance"))).alias("nearest"),
                                         F.count("*").alias("n")).filter("nearest IS NOT NULL AND n > 1")
        members = materialise(
            known.join(edge, "cell").filter(outside | (F.col("distance") >= F.col("nearest") - limit - 1e-9))
            .select("cell", "class"), "members")
    known = reduce(DataFrame.unionByName, links, light.filter("false").select(F.col("class").alias("a"), F.col("class").alias("b")))
    roots = components(known).withColumnRenamed("node", "class")
    members = members.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    rest = measured(rest_pairs(materialise(members, "members"), light, limit), light, sets, limit)
    return known.unionByName(materialise(rest.filter(F.col("distance") <= limit + 1e-9).select("a", "b"), "rest"))


def join_similar(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80, size: int = 5) -> DataFrame:
    """``key, n_shingles, component_id, text_hash, root`` for every row of ``df``.

    Two rows link when 100 times the intersection of their sets of ``size``-word shingles is at least ``percent``
    times the union; words are runs of characters other than ASCII white space, with A-Z lower-cased.
    ``component_id`` is the smallest id reachable by links, its own included. Rows without words have no
    shingles and link with nothing. Rows without id take part in links but name no component: theirs is null
    where no row with id is reachable. ``root`` names the component whatever its ids; it is null without shingles.
    Other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = bounded(df).select(F.col(key).cast("long").alias("id"), body.alias("text"),
                               F.xxhash64(body).alias("text_hash"))
    spark = df.sparkSession
    limit = 1 - percent / 100

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bounds, shingles in shingle_sets(batch.column(1), size):
                count = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(count)), batch.column(2).slice(first, len(count)),
                     pa.array(signed(class_ids(bounds, shingles))), pa.array(count.astype(np.int64))],
                    names=["id", "text_hash", "class", "n_shingles"])

    rows = materialise(texts.mapInArrow(describe, "id long, text_hash long, class long, n_shingles long"), "classes")
    level = spark.sparkContext.broadcast(levels(texts, size))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, bounds, shingles in shingle_sets(batch.column(0), size):
                count = np.diff(bounds)
                row = rows_of(bounds)
                rank = level.value[_cell(shingles)].astype(U64) << U64(58) | shingles >> U64(6)
                order = np.lexsort((rank, row))
                place = np.arange(len(row)) - bounds[:-1][row]
                first = order[place < (count - (percent * count + 99) // 100 + 1)[row]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(shingles[first])), pa.array(signed(class_ids(bounds, shingles))[row[first]])],
                    names=["cell", "class"])

    sigs = texts.select("text").mapInArrow(sign, "cell long, class long")
    shared = sigs.groupBy("cell").agg(F.min("class").alias("least"), F.max("class").alias("most")) \
        .filter("least < most").select("cell")
    members = materialise(sigs.join(shared, "cell").distinct(), "members")
    wanted = members.select("class").distinct()
    sets = Sets(texts.select("id", "text"), rows, size)
    roots = components(linked_classes(members, sets.counted(wanted), sets, limit))
    known = rows.filter("n_shingles > 0").groupBy("class").agg(F.min("id").alias("least"))
    named = known.join(roots, known["class"] == roots["node"], "left").select(
        "class", "least", F.coalesce("root", "class").alias("root"))
    component = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = named.join(component, "root").select("class", "component", "root")
    return rows.join(classes, "class", "left").select(
        F.col("id").alias(key), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"), "text_hash",
        "root")
