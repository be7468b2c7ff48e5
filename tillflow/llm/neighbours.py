"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into equal parts by bisection and swaps, and a small
network learns which part a vector's neighbours lie in. Every row of the table is then put into its most
probable part, and a query is answered from its several most probable ones, where exact distances rank the
rows. How many parts a query visits is set on sample vectors that were held out, so that they find
``RECALL`` of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.vectors import lists, matrix, sample, usable
from tillflow.session import materialise

#: Rows that the parts are learned from, at most, and rows per part of that sample.
SAMPLE_ROWS, PART_ROWS = 8192, 256
GRAPH_K, HIDDEN, STEPS, RATE, SEED = 10, 96, 600, 0.01, 5
RECALL, HELD_OUT = 0.97, 512
#: Rows and queries that one task compares.
CHUNK = 8192


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Row numbers of the ``k`` nearest rows of each query."""
    out = []
    norms = (rows ** 2).sum(axis=1)
    for first in range(0, len(queries), 512):
        block = queries[first:first + 512]
        distance = norms - 2 * block @ rows.T
        if skip_self:
            distance[np.arange(len(block)), first + np.arange(len(block))] = np.inf
        out.append(np.argpartition(distance, min(k, len(rows) - 1), axis=1)[:, :k])
    return np.concatenate(out)


def bisect(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Halves of equal size that cut few of the graph's edges ``(a, b)``: true for one half.

    From the halves along the main axis, pairs of rows are swapped while that mends more edges than it cuts.
    """
    size = len(rows)
    centred = rows - rows.mean(axis=0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    side = np.zeros(size, bool)
    side[np.argsort(centred @ axis, kind="stable")[size // 2:]] = True
    for _ in range(30):
        across = np.where(side[a] != side[b], 1.0, -1.0)
        gain = np.bincount(a, across, size) + np.bincount(b, across, size)
        ones, zeros = np.flatnonzero(side), np.flatnonzero(~side)
        ones, zeros = ones[np.argsort(-gain[ones], kind="stable")], zeros[np.argsort(-gain[zeros], kind="stable")]
        n = min(len(ones), len(zeros))
        good = np.flatnonzero(gain[ones[:n]] + gain[zeros[:n]] > 0)
        swaps = max(1, len(good) // 4) if len(good) else 0
        if not swaps:
            break
        before = int((side[a] != side[b]).sum())
        trial = side.copy()
        trial[ones[:swaps]], trial[zeros[:swaps]] = False, True
        if int((trial[a] != trial[b]).sum()) >= before:
            break
        side = trial
    return side


def partition(rows: np.ndarray, near: np.ndarray, levels: int) -> np.ndarray:
    """The part of each row: ``2**levels`` balanced parts of the neighbour graph."""
    part = np.zeros(len(rows), np.int64)
    a, b = np.repeat(np.arange(len(rows)), near.shape[1]), near.ravel()
    for _ in range(levels):
        halves = np.zeros(len(rows), np.int64)
        for number in range(int(part.max()) + 1):
            inside = np.flatnonzero(part == number)
            if len(inside) < 2:
                continue
            place = np.full(len(rows), -1)
            place[inside] = np.arange(len(inside))
            kept = (place[a] >= 0) & (place[b] >= 0)
            halves[inside] = bisect(rows[inside], place[a[kept]], place[b[kept]])
        part = part * 2 + halves
    return part


class Router:
    """A network of one hidden layer that gives each part the probability to hold a vector's neighbours."""

    def __init__(self, length: int, parts: int):
        random = np.random.default_rng(SEED)
        self.first = random.normal(0, 1 / np.sqrt(length), (length + 1, HIDDEN))
        self.second = random.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN + 1, parts))
        self.center, self.scale = np.zeros(length), 1.0

    def _forward(self, rows: np.ndarray):
        rows = (rows - self.center) / self.scale
        rows = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
        hidden = np.maximum(rows @ self.first, 0)
        hidden = np.concatenate([hidden, np.ones((len(rows), 1))], axis=1)
        score = hidden @ self.second
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return rows, hidden, score / score.sum(axis=1, keepdims=True)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return self._forward(rows)[2]

    def fit(self, rows: np.ndarray, wanted: np.ndarray) -> None:
        self.center, self.scale = rows.mean(axis=0), max(float(rows.std()), 1e-9)
        random = np.random.default_rng(SEED)
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (self.first, self.second)]
        for step in range(1, STEPS + 1):
            some = random.integers(0, len(rows), 512)
            inputs, hidden, found = self._forward(rows[some])
            error = (found - wanted[some]) / len(some)
            back = (error @ self.second[:-1].T) * (hidden[:, :-1] > 0)
            rate = RATE * (1 - step / (STEPS + 1))
            for weight, moment, gradient in zip((self.first, self.second), moments, (inputs.T @ back, hidden.T @ error)):
                gradient = gradient + 1e-5 * weight
                moment[0] = 0.9 * moment[0] + 0.1 * gradient
                moment[1] = 0.999 * moment[1] + 0.001 * gradient ** 2
                weight -= rate * moment[0] / (1 - 0.9 ** step) / (np.sqrt(moment[1] / (1 - 0.999 ** step)) + 1e-8)


def learn(rows: np.ndarray, k: int) -> tuple[Router | None, int]:
    """The router and how many parts a query visits; no router for a sample of one part."""
    levels = max(0, int(np.log2(max(1, len(rows) / PART_ROWS))))
    if not levels:
        return None, 1
    near = nearest(rows, rows, min(GRAPH_K, len(rows) - 1), True)
    part = partition(rows, near, levels)
    held = np.random.default_rng(SEED).permutation(len(rows))[:min(HELD_OUT, len(rows) // 8)]
    fitted = np.ones(len(rows), bool)
    fitted[held] = False
    wanted = np.zeros((len(rows), 1 << levels))
    np.add.at(wanted, (np.repeat(np.arange(len(rows)), near.shape[1]), part[near].ravel()), 1.0)
    wanted[np.arange(len(rows)), part] += 1
    wanted /= wanted.sum(axis=1, keepdims=True)
    router = Router(rows.shape[1], 1 << levels)
    router.fit(rows[fitted], wanted[fitted])
    chance = router.probabilities(rows)
    home = chance.argmax(axis=1)
    order = np.argsort(-chance[held], axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    true = nearest(rows[held], rows, min(k + 1, len(rows) - 1), False)
    reached = np.sort(np.concatenate([rank[i][home[t[t != held[i]]]] for i, t in enumerate(true)]))
    return router, int(reached[min(len(reached) - 1, int(np.ceil(RECALL * len(reached))))]) + 1


def _ranked(queries: pa.Table, rows: pa.Table, length: int, k: int) -> pa.Table:
    """The ``k`` nearest of these rows for each of these queries, by distance, then by id."""
    out: dict[str, list] = {"query_id": [], "mark": [], "vec_id": [], "score": []}
    if queries.num_rows and rows.num_rows:
        ids, vectors = rows["id"].to_numpy(), matrix(rows["vec"], length)
        for query, mark, vector in zip(queries["id"].to_numpy(), queries["mark"].to_numpy(), matrix(queries["vec"], length)):
            distance = np.sqrt(((vectors - vector) ** 2).sum(axis=1))
            distance[ids == query] = np.inf
            some = np.arange(len(ids))
            if len(ids) > k:
                some = np.flatnonzero(distance <= np.partition(distance, k)[k])
            some = some[np.lexsort((ids[some], distance[some]))]
            some = some[np.isfinite(distance[some])][:k]
            for name, values in zip(out, (np.full(len(some), query), np.full(len(some), mark), ids[some], distance[some])):
                out[name].append(values)
    return pa.table({name: pa.array(np.concatenate(v) if v else np.zeros(0, np.float64 if name == "score" else np.int64))
                     for name, v in out.items()})


def search(df: DataFrame, vector: str = "embedding", key: str = "vec_id", every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each row whose id ``every`` divides.

    ``score`` is the Euclidean distance of the original vectors, in double precision; ties go to the smaller
    id, and rows of the query's own id are no candidates. Rows that agree in id and vector are one query but
    several candidates. See :func:`tillflow.llm.vectors.usable` for the rows that take part. All rows are
    indexed; parts and queries beyond ``CHUNK`` rows are divided among tasks.
    """
    rows, length = usable(df, vector, key)
    router, visits = learn(sample(rows, length, SAMPLE_ROWS), k)
    shared = df.sparkSession.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(1), length)
            if shared.value is None or not len(vectors):
                order = np.zeros((len(vectors), 1), np.int32)
            else:
                order = np.argsort(-shared.value.probabilities(vectors), axis=1, kind="stable")[:, :many].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(order)], names=["id", "vec", "parts"])

    schema = "id long, vec array<double>, parts array<int>"
    indexed = materialise(rows.mapInArrow(lambda b: route(b, 1), schema)
                          .select("id", "vec", F.col("parts")[0].alias("part")), "parts")
    asked = materialise(
        rows.filter(F.col("id") % every == 0).dropDuplicates().mapInArrow(lambda b: route(b, visits), schema)
        .withColumn("mark", F.xxhash64("vec")), "queries")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    parts = indexed.groupBy("part").agg(F.count("*").alias("n")).select("part", chunks.alias("chunks"))
    blocks = max(1, -(-asked.count() // CHUNK))
    left = asked.select("id", "mark", "vec", F.explode("parts").alias("part"),
                        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")) \
        .join(parts, "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))) \
        .select("part", "chunk", "block", "id", "mark", "vec")
    right = indexed.join(parts, "part").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .select("part", "chunk", "block", "id", "vec")
    group = ["part", "chunk", "block"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
        lambda q, r: _ranked(q, r, length, k), "query_id long, mark long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
