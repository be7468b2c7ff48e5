"""Embedding near-dedup by iterative quantisation.

A rotation of the principal axes, learned on a bounded sample, turns unit vectors into balanced ``BITS``-bit codes
whose Hamming distances follow their angles. Codes are looked up in ``TABLES`` tables, one per part of the code,
under every key within one bit: vectors meet if any part differs by at most two bits. Pairs within ``RADIUS``
bits are ranked again by the cosine of the original vectors, so no false link remains.

Links whose codes lie farther apart come from an exact pass: every vector is compared with the vectors of one
shard after another, in chunks that lie within a window of angles around a pivot. Chunks that the triangle
inequality of angles proves too far are skipped; on vectors without structure none are, and the pass is quadratic.

Equal vectors count as one with a multiplicity. Dense groups are not expanded into pairs: vectors within half
the limiting angle of one leader are all linked with each other, which the triangle inequality of angles proves,
so such a clique is counted by its size, and only pairs that no clique holds are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.graph import components
from tillflow.llm.units import U64, signed
from tillflow.llm.vectors import matrix, sample, usable
from tillflow.session import materialise

#: Vectors that the rotation is learned from, at most.
SAMPLE_ROWS, ROUNDS, SEED = 16_384, 40, 3
BITS, TABLES = 64, 4
PART_BITS = BITS // TABLES
RADIUS = 20
#: Rows of one key that one task compares; larger keys are divided into blocks.
BLOCK = 4096
#: Vectors of one shard of the exact pass, of one of its chunks, and pivots whose angles order them.
SHARD_ROWS, CHUNK, PIVOTS = 32_768, 512, 64
#: What single precision may take from a cosine; pairs that near to the limit are decided in double precision.
ROUNDING = 1e-4
#: Candidate leaders per key, and how often leaders spread.
LEADERS, SPREADS = 32, 3


class Quantiser:
    """``sign((x - center) @ axes)`` for unit vectors ``x``."""

    def __init__(self, rows: np.ndarray, length: int):
        random = np.random.default_rng(SEED)
        self.center = rows.mean(axis=0) if len(rows) else np.zeros(length)
        centred = rows - self.center
        if length >= BITS and len(rows) > 1:
            axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :BITS]
        else:
            axes = random.normal(size=(length, BITS))
        turn = np.linalg.qr(random.normal(size=(BITS, BITS)))[0]
        flat = centred @ axes
        for _ in range(ROUNDS if len(rows) > 1 else 0):
            left, _, right = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        self.axes = axes @ turn

    def codes(self, rows: np.ndarray) -> np.ndarray:
        bits = (rows - self.center) @ self.axes >= 0
        return (bits.astype(U64) << np.arange(BITS, dtype=U64)).sum(axis=1, dtype=U64)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, first by their largest component so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows ** 2).sum(axis=1, keepdims=True))


def _part(codes: np.ndarray, table: int) -> np.ndarray:
    return codes >> U64(PART_BITS * table) & U64((1 << PART_BITS) - 1)


def _ones(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).astype(np.int64)


def _leading(members: pa.Table, leaders: pa.Table, length: int, cosine: float) -> pa.Table:
    """For each member, the smallest leader within half the limiting angle."""
    nothing = pa.table({"id": pa.array([], pa.int64()), "leader": pa.array([], pa.int64())})
    if not members.num_rows or not leaders.num_rows:
        return nothing
    half = np.cos(np.arccos(cosine) / 2) + 1e-9
    lead = np.sort(leaders["leader"].to_numpy())
    lead_rows = unit(matrix(leaders["lead_vec"], length))[np.argsort(leaders["leader"].to_numpy(), kind="stable")]
    close = unit(matrix(members["vec"], length)) @ lead_rows.T >= half
    some = np.flatnonzero(close.any(axis=1))
    return pa.table({"id": members["id"].to_numpy()[some], "leader": lead[close[some].argmax(axis=1)]})


def cliques(rows: DataFrame, length: int, cosine: float) -> DataFrame:
    """``id, leader``: vectors that share a leader are all linked with each other; ``rows`` has ``id, vec, code``.

    In each table, vectors with the same key look for a leader among those that most of them follow; a vector
    follows the smallest one found, and leaders spread in a few rounds. Any outcome is sound.
    """
    keys = F.explode(F.array(*(F.struct(
        F.lit(t).alias("table"), F.shiftrightunsigned("code", PART_BITS * t).bitwiseAND(F.lit((1 << PART_BITS) - 1)).alias("part"))
        for t in range(TABLES))))
    followed = rows.select("id", F.col("id").alias("leader"))
    for _ in range(SPREADS):
        keyed = rows.select("id", "vec", keys.alias("k")).select("id", "vec", "k.*").join(followed, "id")
        counted = keyed.groupBy("table", "part", "leader").agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("table", "part").orderBy(F.desc("n"), F.xxhash64("leader"), "leader"))
        sizes = counted.groupBy("table", "part").agg(F.sum("n").alias("size")).filter("size > 1") \
            .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        vectors = rows.select(F.col("id").alias("leader"), F.col("vec").alias("lead_vec"))
        chosen = materialise(counted.withColumn("place", place).filter(F.col("place") <= LEADERS)
                             .join(sizes, ["table", "part"]).select("table", "part", "blocks", "leader"), "leaders") \
            .join(vectors, "leader").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
            .select("table", "part", "block", "leader", "lead_vec")
        members = keyed.join(sizes, ["table", "part"]) \
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
            .select("table", "part", "block", "id", "vec")
        group = ["table", "part", "block"]
        found = members.groupBy(*group).cogroup(chosen.groupBy(*group)).applyInArrow(
            lambda m, c: _leading(m, c, length, cosine), "id long, leader long")
        followed = materialise(
            rows.select("id").join(found.groupBy("id").agg(F.min("leader").alias("found")), "id", "left")
            .select("id", F.coalesce("found", "id").alias("leader")), "leaders")
    return followed


def _pairs(table: pa.Table) -> pa.Table:
    """Candidate pairs of one key and pair of blocks: near codes, no shared leader, and this key their first.

    A pair meets under up to 68 keys; it is reported under the first table where its parts are within two bits,
    by the smallest key that both were filed under.
    """
    ids, codes, leaders, blocks = (table[c].to_numpy() for c in ("id", "code", "leader", "own"))
    number, key, low, high = (int(table[c][0].as_py()) for c in ("table", "part", "low", "high"))
    codes = codes.view(U64)
    left = np.flatnonzero(blocks == low)
    right = np.flatnonzero(blocks == high)
    out_a, out_b = [], []
    for one in left:
        other = right[ids[right] > ids[one]] if low == high else right
        differ = codes[other] ^ codes[one]
        near = other[(_ones(differ) <= RADIUS) & (leaders[other] != leaders[one])]
        if not len(near):
            continue
        differ = codes[near] ^ codes[one]
        first = np.ones(len(near), bool)
        for earlier in range(number):
            first &= _ones(_part(differ, earlier)) > 2
        own = _part(codes[[one]], number)[0]
        bits = _part(differ, number)
        lowest = bits & (~bits + U64(1))
        highest = bits ^ lowest
        count = _ones(bits)
        # Keys that both are filed under: own at no difference every key within a bit; at one, both parts; at
        # two, the two parts between them.
        base = _around(int(own)).min()
        smallest = np.where(count == 0, U64(base), np.where(
            count == 1, np.minimum(own, own ^ bits), np.minimum(own ^ lowest, own ^ highest)))
        near = near[first & (count <= 2) & (smallest == U64(key))]
        out_a.append(np.full(len(near), ids[one]))
        out_b.append(ids[near])
    a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _around(part: int) -> np.ndarray:
    """A part of a code and all parts one bit away."""
    return np.array([part] + [part ^ 1 << bit for bit in range(PART_BITS)], np.int64)


def candidates(coded: DataFrame) -> DataFrame:
    """``a, b``: each pair of vectors once that the tables bring together within ``RADIUS`` bits.

    ``coded`` has ``id, code, leader``. Codes, not vectors, are filed; a key with many rows is compared block by
    block.
    """
    flips = np.array([0] + [1 << bit for bit in range(PART_BITS)], np.int64)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1).to_numpy().view(U64)
            for table in range(TABLES):
                part = (_part(codes, table).astype(np.int64)[:, None] ^ flips).ravel()
                row = pa.array(np.repeat(np.arange(len(codes)), len(flips)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(row) for c in range(3)), pa.array(np.full(len(part), table, np.int32)),
                     pa.array(part)], names=["id", "code", "leader", "table", "part"])

    filed = coded.select("id", "code", "leader").mapInArrow(
        file, "id long, code long, leader long, table int, part long")
    sizes = filed.groupBy("table", "part").agg(F.count("*").alias("size"), F.min("leader").alias("one"),
                                               F.max("leader").alias("other")) \
        .filter("one < other").select("table", "part", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = filed.join(sizes, ["table", "part"]) \
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    return placed.groupBy("table", "part", "low", "high").applyInArrow(_pairs, "a long, b long")


def _covered(differ: np.ndarray) -> np.ndarray:
    """Whether codes that differ so meet in the tables within ``RADIUS`` bits."""
    least = np.min([_ones(_part(differ, table)) for table in range(TABLES)], axis=0)
    return (least <= 2) & (_ones(differ) <= RADIUS)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def far_pivots(rows: np.ndarray) -> np.ndarray:
    """Up to ``PIVOTS`` of the rows, each the one farthest from those before it."""
    chosen = rows[:1]
    nearest = rows @ chosen[0] if len(rows) else np.zeros(0)
    while 0 < len(chosen) < min(PIVOTS, len(rows)):
        chosen = np.concatenate([chosen, rows[[nearest.argmin()]]])
        nearest = np.maximum(nearest, rows @ chosen[-1])
    return chosen


class Shard:
    """Vectors in chunks of one pivot each, with the least and the largest angle of a chunk to its pivot."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, leaders: np.ndarray, rows: np.ndarray, pivots: np.ndarray):
        angles = _angles(rows, pivots)
        pivot = angles.argmin(axis=1)
        angle = angles[np.arange(len(rows)), pivot]
        order = np.lexsort((angle, pivot))
        self.ids, self.codes, self.leaders = ids[order], codes[order], leaders[order]
        self.rows, self.pivots = rows[order].astype(np.float32), pivots
        self.chunks = []
        for number in np.unique(pivot):
            first, end = np.searchsorted(pivot[order], [number, number + 1])
            for start in range(first, end, CHUNK):
                stop = min(start + CHUNK, end)
                self.chunks.append((start, stop, number, angle[order[start]], angle[order[stop - 1]]))

    def missed(self, ids: np.ndarray, codes: np.ndarray, leaders: np.ndarray, rows: np.ndarray, same: np.ndarray,
               cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs near the limit or above it that no table and no clique holds; ``same`` rows are in the shard too."""
        wide = np.arccos(np.clip(cosine, -1, 1)) + 1e-6
        angles = _angles(rows, self.pivots)
        single = rows.astype(np.float32)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, stop, number, low, high in self.chunks:
            some = np.flatnonzero((angles[:, number] >= low - wide) & (angles[:, number] <= high + wide))
            a, b = np.nonzero(single[some] @ self.rows[start:stop].T >= cosine - ROUNDING)
            a, b = some[a], b + start
            new = (leaders[a] != self.leaders[b]) & ~(same[a] & (ids[a] >= self.ids[b]))
            a, b = a[new], b[new]
            if len(a):
                new = ~_covered(codes[a] ^ self.codes[b])
                out_a.append(ids[a[new]])
                out_b.append(self.ids[b[new]])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return np.minimum(a, b), np.maximum(a, b)


def beyond_tables(classes: DataFrame, length: int, cosine: float, pivots: np.ndarray) -> DataFrame:
    """``a, b``: each pair once that :func:`candidates` cannot bring together and whose cosine reaches the limit, but
    for rounding. ``classes`` has ``id, code, leader, vec``.
    """
    spark = classes.sparkSession
    number = -(-classes.count() // SHARD_ROWS)
    placed = classes.select("id", "code", "leader", "vec").withColumn(
        "shard", F.pmod(F.xxhash64("id"), F.lit(max(number, 1))).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(c).to_numpy().tobytes() for c in range(3)]
            rows = unit(matrix(batch.column(3), length)) if batch.num_rows else np.zeros((0, length))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in (*parts, rows.tobytes())],
                                             names=["id", "code", "leader", "rows"])

    found = spark.createDataFrame([], "a long, b long")
    for shard in range(number):
        packed = placed.filter(F.col("shard") == shard)             .mapInArrow(pack, "id binary, code binary, leader binary, rows binary").collect()
        ids, codes, leaders, rows = (np.frombuffer(b"".join(r[c] for r in packed), kind) for c, kind in (
            ("id", np.int64), ("code", U64), ("leader", np.int64), ("rows", np.float64)))
        shared = spark.sparkContext.broadcast(Shard(ids, codes, leaders, rows.reshape(-1, length), pivots))

        def compare(batches: Iterator[pa.RecordBatch], shard: int = shard, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    a, b = shared.value.missed(
                        batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64), batch.column(2).to_numpy(),
                        unit(matrix(batch.column(3), length)), batch.column(4).to_numpy() == shard, cosine)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        # Pairs of two shards are compared where the larger one is shared.
        part = placed.filter(F.col("shard") <= shard).mapInArrow(compare, "a long, b long")
        found = found.unionByName(materialise(part, "beyond"))
    return found


def link_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = 0.9) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row of ``df``.

    Rows link where the cosine of their vectors, in double precision, is at least ``cosine``; all links are found, by
    the tables or by the exact pass, none below is reported. ``n_links`` counts the other rows linked directly, ``component_id`` is
    the smallest id reachable and ``kept`` marks the rows that carry it. Rows that take no part (see
    :func:`tillflow.llm.vectors.usable`) link with nothing; a null id has no component and is not kept. Rows
    that repeat an id with different vectors are separate vectors of one id; their links add up by row. Other
    columns are not read.
    """
    rows, length = usable(df, vector, key)
    rows = rows.withColumn("hash", F.xxhash64("vec"))
    sampled = unit(sample(rows, length, SAMPLE_ROWS))
    quantiser = Quantiser(sampled, length)
    shared = df.sparkSession.sparkContext.broadcast(quantiser)

    @F.arrow_udf("long")
    def code(column: pa.Array) -> pa.Array:
        return pa.array(signed(shared.value.codes(unit(matrix(column, length)))) if len(column) else [], pa.int64())

    # One row stands for equal vectors; it is named by their hash, so that repeated ids do not meet.
    classes = materialise(rows.groupBy("hash", "vec").agg(F.count("*").alias("times"), F.min("id").alias("least"))
                          .select(F.col("hash").alias("id"), "vec", "times", "least", code("vec").alias("code")), "classes")
    followed = cliques(classes.select("id", "vec", "code"), length, cosine)
    coded = materialise(classes.select("id", "code", "times").join(followed, "id"), "coded")
    near = classes.select("id", "code", "vec").join(followed, "id")
    found = candidates(coded).unionByName(beyond_tables(materialise(near, "near"), length, cosine, far_pivots(sampled)))
    a, b = (classes.select(F.col("id").alias(c), F.col("vec").alias(f"{c}_vec"), F.col("times").alias(f"{c}_times"))
            for c in "ab")

    @F.arrow_udf("boolean")
    def linked(one: pa.Array, other: pa.Array) -> pa.Array:
        if not len(one):
            return pa.array([], pa.bool_())
        return pa.array((unit(matrix(one, length)) * unit(matrix(other, length))).sum(axis=1) >= cosine)

    links = materialise(found.join(a, "a").join(b, "b").filter(linked("a_vec", "b_vec"))
                        .select("a", "b", "a_times", "b_times"), "links")
    sides = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b_times").alias("n")),
                                           F.struct(F.col("b").alias("id"), F.col("a_times").alias("n")))).alias("s")) \
        .select("s.*").groupBy("id").agg(F.sum("n").alias("across"))
    inside = coded.groupBy("leader").agg(F.sum("times").alias("clique"))
    roots = components(links.select("a", "b").unionByName(
        followed.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))))
    named = classes.select("id", "least").join(roots, classes["id"] == roots["node"], "left") \
        .withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    whole = coded.select("id", "leader").join(inside, "leader").join(sides, "id", "left") \
        .withColumn("n_links", F.col("clique") - 1 + F.coalesce("across", F.lit(0))) \
        .join(named.select("id", "root"), "id").join(least, "root").select(F.col("id").alias("hash"), "n_links", "component")
    answers = rows.select("id", "hash").dropDuplicates().join(whole, "hash")
    per_row = df.select(F.col(key).cast("long").alias("id"),
                        F.xxhash64(F.col(vector).cast("array<double>")).alias("hash"))
    joined = per_row.join(answers, ["id", "hash"], "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
