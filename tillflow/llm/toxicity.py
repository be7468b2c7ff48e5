"""Toxicity: class-conditional Kneser-Ney models compared by length-normalised log-likelihood.

The models predict letters: a text is its lower-cased bytes with everything outside words made one space. For
each class the counts of the longest letter runs are gathered exactly from all labelled texts of the counting
folds; shorter runs count their distinct continuations, as Kneser-Ney does. Below ``OWN_ORDER`` letters both
classes back off to one shared model, so an expression that one class has hardly seen costs both the same.

Every run interpolates ``a(run) + b(context) * P(shorter run)``. The tables of ``a`` and ``b`` are made with
joins and aggregates, grow with the text, and hold every run. For scoring they are dealt into shards of about
``SHARD_RUNS`` runs by the letters before the scored one: all that a letter's probability needs lies in one
shard, so a text's sums add up over shards, and tasks hold one shard at a time.

A text's score is logistic in the mean log ratio per letter, its positive part, and the share of letters whose
ratio is strong; the few weights are fitted on the fold that no count has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.llm.batches import bounded
from tillflow.llm.units import LOWER, U64, byte_table, mix, signed, slices
from tillflow.session import materialise, new_dir

#: Letters of the longest run; the shortest run that each class counts for itself.
ORDER, OWN_ORDER = 6, 4
DISCOUNT = 0.75
#: Runs and contexts of one shard, about; each takes 32 bytes of a task's memory.
SHARD_RUNS = 1 << 22
#: Letters before the scored one that choose its shard. Shorter contexts, and runs up to this size, are in every shard.
SHARD_LETTERS = 3
SPREAD, SPREAD_BITS = 2654435761, 20
#: The key of an empty slot; no run has this hash.
EMPTY = U64(0xFFFFFFFFFFFFFFFF)
#: Rows of the calibration fold that the few weights are fitted on at most, smallest hashes first.
CALIBRATION_ROWS = 50_000
#: Labelled ids that are broadcast at most, about 100 MB of them.
BROADCAST_LABELS = 1 << 22
STRONG = 3.0
#: Bytes of texts scored together, few enough to stay in a core's cache.
SLICE_BYTES = 1 << 17
#: Folds of ``crc32(id as text) mod 5``: never learned from; used for calibration; the rest are counted.
HELD_OUT, CALIBRATION, FOLDS = 0, 1, 5

_SPACE = np.uint8(0x20)
_LETTER = byte_table((0x61, 0x7A), (0x80, 0xFF))
_MAP = np.where(_LETTER[LOWER], LOWER, _SPACE).astype(np.uint8)


def fold(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("fold", F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT)))


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, each behind and before a space, and where each text's begin."""
    mapped = _MAP[data]
    space = mapped == _SPACE
    drop = np.zeros(len(mapped), bool)
    if len(mapped):
        drop[1:] = space[1:] & space[:-1]
        inner = offsets[:-1][np.diff(offsets) > 0]
        drop[inner] = space[inner]
    keep = np.flatnonzero(~drop)
    bounds = np.searchsorted(keep, offsets)
    return np.insert(mapped[keep], bounds, _SPACE)[:], bounds + np.arange(len(bounds))


def runs(units: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` letters that end at each place as one number; the first ``size - 1`` places wrap."""
    out = np.zeros(len(units), U64)
    for back in range(size):
        out |= np.roll(units, back).astype(U64) << U64(8 * back)
    return out


def _within(bounds: np.ndarray, size: int) -> np.ndarray:
    """Places whose run of ``size`` letters lies in one text; a text ends before its successor's space."""
    total = int(bounds[-1])
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    return np.arange(total) - begin >= size - 1


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    units, bounds = letters(data, offsets)
    return units[:int(bounds[-1])], bounds


def count_runs(labelled: DataFrame) -> DataFrame:
    """``run, class, n``: exact counts of the longest runs in texts with a class; one row per run and class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for first, last, data, offsets in slices(batch.column(0), 8 << 20):
                units, bounds = _units(data, offsets)
                whole = _within(bounds, ORDER)
                owner = np.repeat(label[first:last], np.diff(bounds))[whole]
                values = runs(units, ORDER)[whole]
                for kind in (0, 1):
                    run, n = np.unique(values[owner == kind], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(run)), pa.array(np.full(len(run), kind, np.int32)), pa.array(n)],
                        names=["run", "class", "n"])

    return labelled.mapInArrow(count, "run long, class int, n long").groupBy("run", "class").agg(F.sum("n").alias("n"))


def _shorter(column: str, size: int) -> F.Column:
    """The run without its first letter: its last ``size`` letters."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * size) - 1))


def tables(top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(runs, contexts)``: ``size, class, run, n, value`` of all orders; class -1 is shared.

    A run's value is its discounted share of its context; a context's value is what the discount freed, for the
    runs one letter longer.
    """
    levels = []
    counts = top
    for size in range(ORDER, 0, -1):
        if size == OWN_ORDER - 1:
            counts = counts.select("run", F.lit(-1).alias("class"), "n").groupBy("run", "class").agg(F.sum("n").alias("n"))
        counts = materialise(counts, f"runs{size}")
        levels.append((size, counts))
        counts = counts.select(_shorter("run", size - 1).alias("run"), "class") \
            .groupBy("run", "class").agg(F.count("*").alias("n"))
    own_runs, own_contexts = [], []
    for size, counts in levels:
        keyed = counts.withColumn("context", F.shiftright("run", 8))
        contexts = keyed.groupBy("context", "class").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        own_contexts.append(contexts.select(
            F.lit(size - 1).alias("size"), "class", F.col("context").alias("run"), F.col("total").alias("n"),
            (F.lit(DISCOUNT) * F.col("kinds") / F.col("total")).alias("value")))
        own_runs.append(keyed.join(contexts, ["context", "class"]).select(
            F.lit(size).alias("size"), "class", "run", "n", ((F.col("n") - DISCOUNT) / F.col("total")).alias("value")))
    both = []
    for parts in (own_runs, own_contexts):
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        both.append(whole)
    return both[0], both[1]


def _hash(run: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return mix(run | np.atleast_1d(size).astype(U64) << U64(56))


class Table:
    """The values of both classes for every run given, by the run's hash, which no other run has.

    Runs lie in the order of their hashes, each in the first free slot from the one its hash points to.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        order = np.argsort(keys)
        self.slots = 2 * len(keys) + 1
        at = np.arange(len(keys))
        at += np.maximum.accumulate(self._home(keys[order]) - at) if len(keys) else 0
        self.records = np.empty((max(self.slots, int(at[-1]) + 1 if len(at) else 0) + 1, 2), U64)
        # Both values are kept and fetched as one number of eight bytes.
        self.missing = np.full(2, missing, np.float32).view(U64)[0]
        self.records[:, 0], self.records[:, 1] = EMPTY, self.missing
        self.records[at, 0] = keys[order]
        self.records[at, 1] = values[order].view(U64)[:, 0]

    def _home(self, hashed: np.ndarray) -> np.ndarray:
        return ((hashed >> U64(32)) * U64(self.slots) >> U64(32)).astype(np.int64)

    def look(self, hashed: np.ndarray) -> np.ndarray:
        slot = self._home(hashed)
        key = self.records[slot, 0]
        pair = np.where(key == hashed, self.records[slot, 1], self.missing)
        some = np.flatnonzero(key < hashed)
        slot = slot[some]
        while len(some):
            slot = slot + 1
            key = self.records[slot, 0]
            hit = key == hashed[some]
            pair[some[hit]] = self.records[slot[hit], 1]
            more = key < hashed[some]
            some, slot = some[more], slot[more]
        return pair.view(np.float32).reshape(-1, 2)


class Model:
    """The shards of the tables ``(runs, contexts)``; a task that needs several holds one at a time."""

    def __init__(self, shards: list[Broadcast]):
        self.shards = shards

    def __len__(self) -> int:
        return len(self.shards)

    def __iter__(self) -> Iterator[tuple[Table, Table]]:
        for shard in self.shards:
            yield shard.value
            if len(self.shards) > 1:
                shard.__dict__.pop("_value", None)


def _sided(table: DataFrame, missing: float) -> DataFrame:
    """``size, run, ordinary, toxic``: one row per run. Shared runs have one value for both classes; a class that
    has not seen a run that the other has gets ``missing``.
    """

    def of(kind: int) -> Column:
        value = F.max(F.when(F.col("class").isin(kind, -1), F.col("value")))
        return F.coalesce(value, F.lit(missing)).cast("float")

    return table.groupBy("size", "run").agg(of(0).alias("ordinary"), of(1).alias("toxic"))


def _laid(sided: DataFrame, missing: float) -> Table:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _hash(batch.column(1).to_numpy().view(U64), batch.column(0).to_numpy())
            values = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([values.tobytes()])],
                                             names=["keys", "values"])

    packed = sided.select("size", "run", "ordinary", "toxic").mapInArrow(pack, "keys binary, values binary")
    found = [(np.frombuffer(row["keys"], U64), np.frombuffer(row["values"], np.float32).reshape(-1, 2))
             for row in packed.toLocalIterator()]
    if not found:
        return Table(np.zeros(0, U64), np.zeros((0, 2), np.float32), missing)
    return Table(np.concatenate([k for k, _ in found]), np.concatenate([v for _, v in found]), missing)


def layout(table: DataFrame, missing: float) -> Table:
    """All runs of the table, for lookups by hash."""
    return _laid(_sided(table, missing), missing)


def _dealt(sided: DataFrame, number: int, last: int) -> DataFrame:
    """``sided`` stored by ``shard``; the letters that choose it end ``last`` letters before the end of the run."""
    letters_of = F.shiftright("run", 8 * last).bitwiseAND(F.lit((1 << 8 * SHARD_LETTERS) - 1))
    one = F.array((F.shiftright(letters_of * F.lit(SPREAD), SPREAD_BITS) % number).cast("int"))
    every = F.array(*(F.lit(n) for n in range(number)))
    short = F.col("size") < SHARD_LETTERS + last
    path = new_dir(sided.sparkSession, "shards")
    sided.withColumn("shard", F.explode(F.when(short, every).otherwise(one))).write.partitionBy("shard").parquet(path)
    return sided.sparkSession.read.schema("size int, run long, ordinary float, toxic float, shard int").parquet(path)


def build(top: DataFrame, shard_runs: int | None = None) -> Model:
    """The model of all runs, in as many shards as their number asks for."""
    context = top.sparkSession.sparkContext
    sided = [(materialise(_sided(table, missing), "sided"), missing, last)
             for table, missing, last in zip(tables(top), (0.0, 1.0), (1, 0))]
    number = -(-sum(rows.count() for rows, _, _ in sided) // (shard_runs or SHARD_RUNS))
    if number <= 1:
        return Model([context.broadcast(tuple(_laid(rows, missing) for rows, missing, _ in sided))])
    dealt = [(_dealt(rows, number, last), missing) for rows, missing, last in sided]
    return Model([context.broadcast(tuple(_laid(rows.filter(F.col("shard") == shard), missing) for rows, missing in dealt))
                  for shard in range(number)])


def shard_of(units: np.ndarray, number: int) -> np.ndarray:
    """The shard of every letter, chosen by the letters before it."""
    before = np.roll(runs(units, SHARD_LETTERS), 1)
    return (before * U64(SPREAD) >> U64(SPREAD_BITS)) % U64(number)


def log_ratios(units: np.ndarray, of_runs: Table, of_contexts: Table, places: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The log of toxic over ordinary probability of every letter at ``places``, given the letters before it.

    A run's context is the run one shorter that ends a place earlier, so its hash is there already.
    """
    both = np.full((len(units[places]), 2), 1 / 256, np.float32)
    context = _hash(np.zeros(len(units), U64), 0)
    run = np.zeros(len(units), U64)
    for size in range(1, ORDER + 1):
        run |= np.roll(units, size - 1).astype(U64) << U64(8 * (size - 1))
        hashed = _hash(run, size)
        both = of_runs.look(hashed[places]) + of_contexts.look(np.roll(context, 1)[places]) * both
        context = hashed
    both = np.log(both)
    return both[:, 1] - both[:, 0]


def describe(column: pa.Array, model: Model) -> np.ndarray:
    """``mean, above, strong, n`` of every text: what its score is made of; zeros for a text without letters."""
    total = np.zeros((3, len(column)))
    n = np.zeros(len(column))
    for shard, (of_runs, of_contexts) in enumerate(model if len(column) else ()):
        for first, last, data, offsets in slices(column, SLICE_BYTES):
            units, bounds = _units(data, offsets)
            whole = _within(bounds, ORDER)
            places = np.flatnonzero(whole if len(model) == 1 else whole & (shard_of(units, len(model)) == shard))
            ratio = np.zeros(len(units))
            if len(places):
                ratio[places] = log_ratios(units, of_runs, of_contexts, places)
            n[first:last] = np.maximum(np.diff(bounds) - (ORDER - 1), 0)
            sums = [np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
                    for x in (ratio, np.maximum(ratio, 0), ratio > STRONG)]
            total[:, first:last] += np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums])
    return np.concatenate([total / np.maximum(n, 1), n[None]])


def features(texts: DataFrame, model) -> DataFrame:
    """``id, class`` and what :func:`describe` finds, for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2)] + [pa.array(f) for f in describe(batch.column(1), model)],
                names=["id", "class", "mean", "above", "strong", "n"])

    return texts.select("id", "text", "class").mapInArrow(
        run, "id long, class int, mean double, above double, strong double, n double")


def _inputs(mean: np.ndarray, above: np.ndarray, strong: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([mean * 10, above * 10, np.sqrt(strong) * 10, np.log1p(n), np.ones(len(mean))], axis=1)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights by Newton steps; without both classes, the weights of a plain ratio."""
    if len(set(y.tolist())) < 2:
        return np.array([1.0, 0, 0, 0, -2.0])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic"):
    """``(model, weights)`` from the labelled rows of ``df`` outside the held-out fold."""
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("class")) \
        .filter("id IS NOT NULL AND class IN (0, 1)").groupBy("id").agg(F.max("class").alias("class"))
    texts = fold(bounded(df).select(F.col(key).cast("long").alias("id"),
                                    F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "id")
    known = materialise(fold(known, "id").filter(F.col("fold") != HELD_OUT).drop("fold"), "known")
    # Texts stay where they are while the labelled ids fit a task; beyond that both sides are shuffled.
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known.hint("merge")
    classed = texts.filter(F.col("fold") != HELD_OUT).join(known, "id")
    top = materialise(count_runs(classed.filter(F.col("fold") != CALIBRATION).select("text", "class")), "runs")
    model = build(top)
    sample = features(classed.filter(F.col("fold") == CALIBRATION), model) \
        .orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS).collect()
    x = _inputs(*(np.array([r[c] for r in sample], float) for c in ("mean", "above", "strong", "n")))
    return model, fit_weights(x, np.array([r["class"] for r in sample], float))


def scorer(spark: SparkSession, trained):
    """A column function from texts to scores; null and empty texts get the score of no evidence."""
    model, weights = trained

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(_inputs(*describe(column, model)) @ weights, -500, 500))))

    return score


def score_toxicity(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                   label: str = "toxic") -> DataFrame:
    """``key, held_out, score, predicted`` for every row of ``df``; ``predicted`` is 1 from 0.5 up.

    ``labels`` gives a class 0 or 1 to some ids; other values are left out and of several classes of an id the
    larger counts. Rows with ``crc32(id) mod 5 = 0`` and rows without id are held out of all learning. Null and
    empty texts, and texts of fewer letters than a run, get the score of no evidence. Without labels of both
    classes the score is a fixed function of the mean ratio. Other columns are not read.
    """
    score = scorer(df.sparkSession, train(df, labels, text, key, label))
    return fold(bounded(df).select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")), key) \
        .select(key, (F.col("fold") == HELD_OUT).alias("held_out"), score("text").alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
