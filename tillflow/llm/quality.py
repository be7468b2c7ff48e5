"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; each pair of features adds the product of their values times the
dot product of their vectors. The sum over all pairs is half of the squared sum minus the sum of squares, so a
text is scored in time linear in its words. Words are hashed into ``BUCKETS`` features scaled to length one;
the statistics describe how a text is built; the metadata is its declared length, where a column has it.

The model is fitted on the driver from at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hashes of
their ids, and sent to the tasks: less than 1 MB. Scoring covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.batches import bounded
from tillflow.llm.toxicity import HELD_OUT, fold
from tillflow.llm.units import LOWER, PLAIN, U64, byte_table, mix, rows_of, slices, word_bounds, word_hashes

BUCKETS = 1 << 14
RANK = 8
#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 8_000
STEPS, BATCH, RATE, DECAY, SEED = 400, 256, 0.02, 1e-4, 20240607

_CLASSES = np.stack([
    byte_table((0x41, 0x5A)), byte_table((0x61, 0x7A)), byte_table((0x30, 0x39)), byte_table((0x80, 0xFF)),
    byte_table((0x0A, 0x0A)), byte_table((0x20, 0x20), (0x09, 0x09)), byte_table((0x2C, 0x2C), (0x2E, 0x2E)),
    byte_table((0x21, 0x21), (0x3F, 0x3F)), byte_table((0x7C, 0x7C)),
    byte_table((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E)),
])
#: Shares of byte classes, then the statistics of ``_statistics``, then the metadata.
N_STATS = len(_CLASSES) + 8 + 2
N_FEATURES = BUCKETS + N_STATS


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def extract(data: np.ndarray, offsets: np.ndarray, declared: np.ndarray):
    """``(bounds, bucket, value, stats)``: the word features of all texts, and their statistics by row."""
    size = np.diff(offsets).astype(float)
    shares = [_sums(table[data], offsets) / np.maximum(size, 1) for table in _CLASSES]
    starts, ends, word_at = word_bounds(data, offsets, PLAIN)
    words = np.maximum(np.diff(word_at), 1)
    lowered = LOWER[data]
    hashes = word_hashes(lowered, starts, ends)
    row = rows_of(word_at)
    order = np.lexsort((hashes, row))
    sorted_row, sorted_hash = row[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_row[1:] != sorted_row[:-1]) | (sorted_hash[1:] != sorted_hash[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order))).astype(float)
    kind_row = sorted_row[first]
    bounds = np.searchsorted(kind_row, np.arange(len(offsets)))
    bucket = (mix(sorted_hash[first]) >> U64(64 - 14)).astype(np.int64)
    norm = np.sqrt(np.maximum(_sums(times ** 2, bounds), 1))
    most = np.zeros(len(size))
    np.maximum.at(most, kind_row, times)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    wide = ends - starts
    stats = shares + [
        np.log1p(size), np.log1p(np.diff(word_at)), _sums(wide, word_at) / words,
        np.sqrt(np.maximum(_sums(wide.astype(float) ** 2, word_at) / words - (_sums(wide, word_at) / words) ** 2, 0)),
        np.diff(bounds) / words, most / words, _sums(again, word_at) / words,
        _sums(~PLAIN[data], offsets) / np.maximum(size, 1)]
    unknown = ~np.isfinite(declared) | (declared < 0)
    stats += [np.log1p(np.where(unknown, 0, declared)), unknown.astype(float)]
    return bounds, bucket, times / norm[kind_row], np.stack(stats, axis=1)


def _texts(df: DataFrame, text: str, key: str, length: str | None) -> DataFrame:
    declared = F.col(length).cast("double") if length and length in df.columns else F.lit(None).cast("double")
    return fold(bounded(df).select(F.col(key).cast("long").alias("id"),
                          F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                          F.coalesce(declared, F.lit(-1.0)).alias("declared")), "id")


def _sample(texts: DataFrame, known: DataFrame):
    """The rows that the model is fitted on, as feature arrays."""
    chosen = texts.filter(F.col("fold") != HELD_OUT).select("id").join(known, "id") \
        .orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared = batch.column(1).to_numpy()
            for first, last, data, offsets in slices(batch.column(0)):
                bounds, bucket, value, stats = extract(data, offsets, declared[first:last])
                rows = range(last - first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(2).slice(first, last - first), batch.column(3).slice(first, last - first),
                    pa.array([bucket[bounds[r]:bounds[r + 1]].astype(np.int32).tobytes() for r in rows], pa.binary()),
                    pa.array([value[bounds[r]:bounds[r + 1]].astype(np.float32).tobytes() for r in rows], pa.binary()),
                    pa.array([stats[r].tobytes() for r in rows], pa.binary())],
                    names=["id", "class", "bucket", "value", "stats"])

    rows = texts.join(chosen.dropDuplicates(["id"]), "id").select("text", "declared", "id", "class") \
        .mapInArrow(run, "id long, class int, bucket binary, value binary, stats binary").collect()
    return sorted(rows, key=lambda r: (r["id"], r["class"], bytes(r["bucket"])))


class Machine:
    """Weights and vectors; ``center`` and ``scale`` standardise the statistics."""

    def __init__(self, center: np.ndarray, scale: np.ndarray):
        self.center, self.scale = center, scale
        random = np.random.default_rng(SEED)
        self.bias = 0.0
        self.weight = np.zeros(N_FEATURES)
        self.vector = random.normal(0, 0.02, (N_FEATURES, RANK))

    def full(self, bounds: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray):
        """All features of the rows, statistics behind the words: ``(row, feature, value)``."""
        rows = len(stats)
        scaled = np.clip((stats - self.center) / self.scale, -4, 4) / np.sqrt(N_STATS)
        row = np.concatenate([rows_of(bounds), np.repeat(np.arange(rows), N_STATS)])
        feature = np.concatenate([bucket, np.tile(BUCKETS + np.arange(N_STATS), rows)])
        return row, feature, np.concatenate([value, scaled.ravel()])

    def margin(self, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray):
        """The machine's sum for each row, and the sums over features that its gradient reuses."""
        linear = np.bincount(row, self.weight[feature] * value, rows)
        parts = self.vector[feature] * value[:, None]
        summed = np.stack([np.bincount(row, parts[:, f], rows) for f in range(RANK)], axis=1)
        squares = np.bincount(row, (parts ** 2).sum(axis=1), rows)
        return self.bias + linear + 0.5 * ((summed ** 2).sum(axis=1) - squares), summed, parts

    def fit(self, rows: list, label: np.ndarray) -> None:
        """Adam on the logistic loss; each feature's step only where a batch has it."""
        random = np.random.default_rng(SEED)
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.weight, self.vector)]
        bias_moment = [0.0, 0.0]
        steps = 0
        while steps < STEPS:
            order = random.permutation(len(rows))
            for begin in range(0, len(order), BATCH):
                some = [rows[i] for i in order[begin:begin + BATCH]]
                y = label[order[begin:begin + BATCH]]
                bounds = np.cumsum([0] + [len(r[0]) for r in some])
                row, feature, value = self.full(bounds, np.concatenate([r[0] for r in some]),
                                                np.concatenate([r[1] for r in some]), np.stack([r[2] for r in some]))
                margin, summed, parts = self.margin(len(some), row, feature, value)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(some)
                steps += 1
                rate = RATE / (1 + 4 * steps / STEPS)
                used, place = np.unique(feature, return_inverse=True)
                pull = error[row] * value
                gradients = (
                    np.bincount(place, pull, len(used)) + DECAY * self.weight[used],
                    np.stack([np.bincount(place, pull * (summed[row, f] - parts[:, f]), len(used))
                              for f in range(RANK)], axis=1) + DECAY * self.vector[used])
                for target, moment, gradient in zip((self.weight, self.vector), moments, gradients):
                    for k, decay, power in ((0, 0.9, 1), (1, 0.99, 2)):
                        moment[k][used] = decay * moment[k][used] + (1 - decay) * gradient ** power
                    target[used] -= rate * moment[0][used] / (1 - 0.9 ** steps) / (
                        np.sqrt(moment[1][used] / (1 - 0.99 ** steps)) + 1e-8)
                bias_moment = [0.9 * bias_moment[0] + 0.1 * error.sum(), 0.99 * bias_moment[1] + 0.01 * error.sum() ** 2]
                self.bias -= rate * bias_moment[0] / (1 - 0.9 ** steps) / (
                    np.sqrt(bias_moment[1] / (1 - 0.99 ** steps)) + 1e-8)


def train(texts: DataFrame, known: DataFrame) -> Machine | float:
    """The fitted machine, or a constant probability where the labels hold fewer than two classes."""
    sample = _sample(texts, known)
    label = np.array([r["class"] for r in sample], float)
    if len(set(label.tolist())) < 2:
        return float(label.mean()) if len(label) else 0.5
    rows = [(np.frombuffer(r["bucket"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float),
             np.frombuffer(r["stats"], float)) for r in sample]
    stats = np.stack([r[2] for r in rows])
    machine = Machine(stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3))
    machine.bias = float(np.log(label.mean() / (1 - label.mean())))
    machine.fit(rows, label)
    return machine


def score_quality(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                  label: str = "quality", length: str | None = "n_chars", threshold: float = 0.3) -> DataFrame:
    """``key, held_out, score, predicted`` for every row of ``df``; ``predicted`` is 1 from ``threshold`` up.

    ``labels`` gives a class 0 or 1 to some ids; other values are left out and of several classes of an id the
    larger counts. Rows with ``crc32(id) mod 5 = 0`` and rows without id are held out of learning. Null texts
    are empty; empty texts are scored by their statistics. A missing, null or negative length is a feature of
    its own. Without labels of both classes every score is the share of ones, 0.5 without any. Other columns
    are not read.
    """
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("class")) \
        .filter("id IS NOT NULL AND class IN (0, 1)").groupBy("id").agg(F.max("class").alias("class"))
    texts = _texts(df, text, key, length)
    shared = df.sparkSession.sparkContext.broadcast(train(texts, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            declared = batch.column(1).to_numpy()
            scores = []
            for first, last, data, offsets in slices(batch.column(0)):
                if isinstance(machine, float):
                    scores.append(np.full(last - first, machine))
                    continue
                features = machine.full(*extract(data, offsets, declared[first:last]))
                margin = machine.margin(last - first, *features)[0]
                scores.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                names=["id", "held_out", "score"])

    return texts.select("text", "declared", "id", (F.col("fold") == HELD_OUT).alias("held_out")) \
        .mapInArrow(run, "id long, held_out boolean, score double") \
        .select(F.col("id").alias(key), "held_out", "score",
                (F.col("score") >= threshold).cast("int").alias("predicted"))
