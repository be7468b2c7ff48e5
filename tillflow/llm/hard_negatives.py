"""Hard negatives by exact integer scores from residue matrix products.

Components become ``floor(256 * x)``. A block of anchors is multiplied with a chunk of rows once for each of a few
small primes: residues around zero are small enough for a product in float32 to be exact, and the signed score is
put together from its residues by mixed radix. How many primes are needed follows from the longest vectors. A first
pass finds each anchor's positives, its best rows of the same label; a second one finds, for each positive, the best
rows of other labels whose score lies within a window below the positive's.

Blocks of anchors meet chunks of rows as cells of a grid, each compared by one task, which returns the best of its
cell alone; labels and ids divide nothing, so no label is too frequent.

Defined cases: rows without id or label, and vectors that are null, hold null or non-finite components, or are not of
the most frequent length (the longest of equally frequent ones), take no part; zero vectors do. Rows that agree in
id, label and vector count once; others of the anchor's own id are none of its candidates; of one id with several
vectors each is an anchor. Ties go to the smaller id. Scores that may exceed a long raise an error. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.batches import bounded
from tillflow.llm.vectors import matrix
from tillflow.session import materialise

SCALE = 256
#: A cell of the grid, and the anchors whose scores a task holds at a time.
ANCHORS, ROWS, TILE = 4096, 8192, 64
#: float32 holds whole numbers up to this exactly.
EXACT = 1 << 24
LIMIT = 1 << 62

CELL = "anchor_id long, mark long, place int, positive_score long, id long, score long"


def primes_below(top: int) -> Iterator[int]:
    """Primes in falling order."""
    return (n for n in range(top - 1, 2, -1) if all(n % d for d in range(2, int(n ** 0.5) + 1)))


def moduli(bound: int) -> list[int]:
    """Distinct primes whose product tells apart all whole numbers from ``-bound`` to ``bound``."""
    chosen, product = [], 1
    for prime in primes_below(256):
        if product > 2 * bound:
            return chosen
        chosen.append(prime)
        product *= prime
    raise ValueError(f"no primes for scores up to {bound}")


def residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues around zero as float32."""
    half = prime // 2
    return ((values + half) % prime - half).astype(np.float32)


def residue_product(left: np.ndarray, right: np.ndarray, prime: int) -> np.ndarray:
    """``left @ right.T`` modulo ``prime``; columns are taken in slices whose float32 sums stay exact."""
    step = max(1, EXACT // (prime // 2) ** 2)
    total = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, left.shape[1], step):
        total += (left[:, first:first + step] @ right[:, first:first + step].T).astype(np.int64)
    return total % prime


def signed(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The whole numbers nearest zero with these residues, by mixed radix digits (Chinese remaindering)."""
    digits: list[np.ndarray] = []
    for k, prime in enumerate(primes):
        value, unit = np.zeros_like(parts[0]), 1
        for digit, earlier in zip(digits, primes):
            value = (value + digit * unit) % prime
            unit = unit * earlier % prime
        digits.append((parts[k] - value) * pow(unit, -1, prime) % prime)
    # The highest digits are taken around zero, so that sums stay within a long as the score does.
    out = np.zeros_like(parts[0])
    upper = np.zeros(parts[0].shape, bool)
    settled = np.zeros(parts[0].shape, bool)
    for digit, prime in zip(reversed(digits), reversed(primes)):
        upper |= ~settled & (digit > prime // 2)
        settled |= digit != prime // 2
    for digit, prime in zip(reversed(digits), reversed(primes)):
        out = out * prime + np.where(upper, digit - (prime - 1), digit)
    return out - upper


class Scorer:
    """Exact scores of a block of anchors with a chunk of rows; residues are made once."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray, primes: list[int]):
        self.primes = primes
        self.left = [residues(anchors, p) for p in primes]
        self.right = [residues(rows, p) for p in primes]

    def __call__(self, first: int, last: int) -> np.ndarray:
        return signed([residue_product(a[first:last], b, p) for a, b, p in zip(self.left, self.right, self.primes)],
                      self.primes)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    some = np.arange(len(ids))
    if len(ids) > k:
        some = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _cell(anchors: pa.Table, rows: pa.Table, length: int, primes: list[int], k: int, wanted) -> pa.Table:
    """The ``k`` best rows of this cell for everything that ``wanted`` asks of an anchor."""
    out: list[tuple] = []
    if anchors.num_rows and rows.num_rows:
        left, right = matrix(anchors["vec"], length).astype(np.int64), matrix(rows["vec"], length).astype(np.int64)
        score, about = Scorer(left, right, primes), {c: rows[c].to_numpy() for c in ("id", "label")}
        asked = anchors.drop_columns(["vec"]).to_pylist()
        for first in range(0, len(asked), TILE):
            for anchor, line in zip(asked[first:first + TILE], score(first, first + TILE)):
                for place, positive, chosen in wanted(anchor, about, line):
                    at = np.flatnonzero(chosen)
                    best = at[top(about["id"][at], line[at], k)]
                    out += [(anchor["id"], anchor["mark"], place, positive, int(about["id"][b]), int(line[b])) for b in best]
    names = [c.split()[0] for c in CELL.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in CELL.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)


def same_label(anchor: dict, rows: dict, scores: np.ndarray):
    yield 0, 0, (rows["label"] == anchor["label"]) & (rows["id"] != anchor["id"])


def windows(lowest: int, highest: int):
    """Rows of other labels whose score is ``lowest`` to ``highest`` percent of a positive's."""
    def inside(anchor: dict, rows: dict, scores: np.ndarray):
        other = (rows["label"] != anchor["label"]) & (rows["id"] != anchor["id"])
        for positive in anchor["positives"]:
            least, most = -(-lowest * positive["score"] // 100), highest * positive["score"] // 100
            yield positive["place"], positive["score"], other & (scores >= least) & (scores <= most)

    return inside


def usable(df: DataFrame, vector: str, key: str, label: str) -> tuple[DataFrame, int, int]:
    """``id, label, vec, mark`` of the rows that take part, the vectors' length, and a bound of their scores."""
    vec = F.col(vector).cast("array<double>")
    whole = F.transform(vec, lambda x: F.floor(x * SCALE))
    good = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = bounded(df).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), vec.alias("v")) \
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    norm = F.aggregate(F.transform(F.col("v"), lambda x: F.pow(F.floor(x * SCALE).cast("double"), F.lit(2.0))), F.lit(0.0),
                       lambda a, x: a + x)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")) \
        .orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    length, bound = (sizes[0]["size"], sizes[0]["norm"]) if sizes else (1, 0.0)
    if bound >= LIMIT:
        raise ValueError(f"scores up to {bound:.3g} do not fit a long")
    kind = "array<short>" if bound < 2 ** 30 else "array<long>"
    kept = rows.filter(F.size("v") == length).select("id", "label", F.transform("v", lambda x: F.floor(x * SCALE)).cast(kind).alias("vec"))
    return kept.withColumn("mark", F.xxhash64("label", "vec")), length, int(bound) + 1


def mine(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", every: int = 100,
         positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows whose id ``every`` divides."""
    kept, length, bound = usable(df, vector, key, label)
    primes = moduli(bound)
    rows = materialise(kept.dropDuplicates(["id", "mark"]), "vectors")
    anchors = rows.filter(F.col("id") % every == 0)
    blocks, chunks = (max(1, -(-table.count() // size)) for table, size in ((anchors, ANCHORS), (rows, ROWS)))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    chunk = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(chunks)).cast("int").alias("chunk")
    every_block, every_chunk = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
                                for n, name in ((blocks, "block"), (chunks, "chunk")))
    right = rows.select(chunk, every_block, "id", "label", "vec").groupBy("block", "chunk")

    def best(asked: DataFrame, wanted, k: int) -> DataFrame:
        left = asked.select(block, every_chunk, *asked.columns).groupBy("block", "chunk")
        found = left.cogroup(right).applyInArrow(lambda a, r: _cell(a, r, length, primes, k, wanted), CELL)
        order = Window.partitionBy("anchor_id", "mark", "place").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    chosen = materialise(best(anchors, same_label, positives), "positives")
    lists = chosen.groupBy("anchor_id", "mark").agg(F.collect_list(F.struct(F.col("rank").alias("place"), "score")).alias("positives"))
    asked = materialise(anchors.join(lists.withColumnRenamed("anchor_id", "id"), ["id", "mark"]), "asked")
    named = chosen.select("anchor_id", "mark", F.col("rank").alias("place"), F.col("id").alias("positive_id"))
    return best(asked, windows(*window), negatives).join(named, ["anchor_id", "mark", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
