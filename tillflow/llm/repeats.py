"""What the two exact duplicate-span operators share: repeated windows of many texts.

All windows of a fixed length are compared, but few are shuffled. Rows carry anchors with the hash of their
context, that is, of everything the windows of an anchor reach (:class:`tillflow.llm.units.Anchors`):

1. A merged sketch flags the grams of anchors that may occur twice; the others cannot repeat.
2. Occurrences whose whole context occurs elsewhere repeat with all their windows.
3. Where contexts of one gram differ, the contexts are sent and their windows compared in one task, up to
   ``GROUP`` contexts; beyond, the hashes of the single windows are shuffled, so no group is unbounded. One
   occurrence per context takes part.

A text is named by ``(id, tkey)``, its id and a hash of its text, so rows with equal ids stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillflow.llm.batches import bounded
from tillflow.llm.sketch import column_hashes, flags, holds
from tillflow.llm.units import BASES, BYTE_HASH, PLAIN, U64, Anchors, cover, mix, prefix, signed, slices, span
from tillflow.llm.units import word_bounds, word_hashes
from tillflow.session import materialise

#: Contexts of one gram, each about a window and a half long, that are compared in one task.
GROUP = 8192
LAST = (1 << 63) - 1
NAME = ["id", "tkey"]
LANES = ["lane1", "lane2"]
MARK = "id long, tkey long, low int, count int"

Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, where each text's begin, and what to send for a word: its hash."""
    starts, ends, bounds = word_bounds(data, offsets, PLAIN)
    hashes = word_hashes(data, starts, ends)
    return hashes, bounds, hashes


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return BYTE_HASH[data], offsets, data


class Earlier:
    """A window counts as repeated in a text if it also starts in one with a smaller id."""

    who = f"coalesce(id, {LAST})"
    contexts = ("min(who) AS one", "max(who) AS most")
    mixed = ("min(one) AS first", "max(one) AS last")
    differing = "first < last"
    repeated = "most > one"
    member = "who > one"
    windows = ("min(who) AS first", "max(who) AS last")
    window = "first < last"
    later = "who > first"

    @staticmethod
    def name(ids: np.ndarray, tkeys: np.ndarray, low: np.ndarray) -> np.ndarray:
        return ids

    @staticmethod
    def again(who: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return who > np.repeat(np.minimum.reduceat(who, first), size)


class Anywhere:
    """A window counts as repeated if it also starts at any other place."""

    who = "tkey ^ shiftleft(id, 24) ^ low"
    contexts = ("min(who) AS one", "count(*) AS most")
    mixed = ("min(most) AS first",)
    differing = "kinds > 1 AND first = 1"
    repeated = "most > 1"
    member = "true"
    windows = ("count(*) AS first",)
    window = "first > 1"
    later = "true"

    @staticmethod
    def name(ids: np.ndarray, tkeys: np.ndarray, low: np.ndarray) -> np.ndarray:
        return tkeys ^ (ids << 24) ^ low

    @staticmethod
    def again(who: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.repeat(size > 1, size)


def named_texts(df: DataFrame, text: str, key: str, carried: list[str] | None = None) -> DataFrame:
    """``id``, ``tkey`` and ``text`` of every row; a null text is empty, a null id the largest.

    ``given`` is the id as it came, and ``row`` holds the columns to carry along.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return bounded(df).select(F.col(key).cast("long").alias("given"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"),
                     F.xxhash64(body).alias("tkey"), body.alias("text"), F.struct(*(carried or [key])).alias("row"))


def _anchors(batches: Iterator[pa.RecordBatch], units: Units, window: int, gram: int):
    """Anchors of every slice with what belongs to them: ids, text hashes, place in the text, units to send."""
    for batch in batches:
        ids, tkeys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, last, data, offsets in slices(batch.column(2)):
            values, bounds, sent = units(data, offsets)
            found = Anchors(values, bounds, window, gram)
            row = found.row + first
            yield found, ids[row], tkeys[row], found.low - bounds[found.row], sent


def _occurrence(lane: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Names one context's occurrence; Spark's side is :func:`_occurrences`."""
    return mix(lane ^ mix(who.view(U64)))


def _occurrences(contexts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lane, who = (batch.column(c).to_numpy().view(U64) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(signed(_occurrence(lane, who)))], names=["hash"])

    return contexts.select("lane1", "one").mapInArrow(run, "hash long")


def _compare(table: pa.Table, window: int, rule: type, width: type) -> pa.Table:
    """Marks of the windows that contexts of one gram share with others, by the hashes of all their windows."""
    ids, tkeys, low, count, who = (table[c].combine_chunks().to_numpy() for c in ("id", "tkey", "low", "count", "who"))
    units = np.frombuffer(b"".join(table["units"].to_pylist()), width)
    values = BYTE_HASH[units] if width is np.uint8 else units
    first = np.cumsum(count + window - 1) - (count + window - 1)
    owner = np.repeat(np.arange(len(count)), count)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = first[owner] + shift
    one, other = (span(prefix(values, base), start, start + window, base) for base in BASES)
    order = np.lexsort((other, one))
    differ = np.ones(len(order), bool)
    differ[1:] = (one[order][1:] != one[order][:-1]) | (other[order][1:] != other[order][:-1])
    group = np.flatnonzero(differ)
    again = np.empty(len(order), bool)
    again[order] = rule.again(who[owner][order], group, np.diff(np.append(group, len(order))))
    # Runs of marked windows of one context become one mark each.
    edge = np.concatenate([[True], owner[1:] != owner[:-1]])
    begin = np.flatnonzero(again & (edge | ~np.concatenate([[False], again[:-1]])))
    end = np.flatnonzero(again & np.concatenate([edge[1:] | ~again[1:], [True]]))
    pick = owner[begin]
    return pa.table({"id": ids[pick], "tkey": tkeys[pick], "low": (low[pick] + shift[begin]).astype(np.int32),
                     "count": (end - begin + 1).astype(np.int32)})


def marks(texts: DataFrame, units: Units, window: int, gram: int, rule: type) -> DataFrame:
    """``id, tkey, low, count``: runs of windows, by the first one's place, that repeat by ``rule``."""
    spark = texts.sparkSession
    body = texts.select("id", "tkey", "text")
    width = np.uint8 if units is byte_units else np.uint64

    def grams(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for found, *_ in _anchors([batch], units, window, gram):
            yield found.gram

    twice = spark.sparkContext.broadcast(flags(body, grams, 2))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, ids, tkeys, low, _ in _anchors(batches, units, window, gram):
            at = np.flatnonzero(holds(twice.value, found.gram))
            if len(at):
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at]), pa.array(tkeys[at]), pa.array(low[at].astype(np.int32)),
                    pa.array((found.high - found.low + 1)[at].astype(np.int32)),
                    *(pa.array(signed(x[at])) for x in (found.gram, found.lane1, found.lane2))],
                    names=["id", "tkey", "low", "count", "gram", *LANES])

    found = materialise(body.mapInArrow(occurrences, f"{MARK}, gram long, lane1 long, lane2 long"), "anchors") \
        .withColumn("who", F.expr(rule.who))
    contexts = materialise(found.groupBy("gram", *LANES).agg(*map(F.expr, rule.contexts)), "contexts")
    mixed = contexts.groupBy("gram").agg(F.count("*").alias("kinds"), *map(F.expr, rule.mixed)).filter(rule.differing) \
        .select("gram", "kinds")
    differing = materialise(contexts.join(mixed, "gram").select("lane1", "one", "kinds"), "differing")
    few, many = (spark.sparkContext.broadcast(flags(_occurrences(differing.filter(part)), column_hashes, 1))
                 for part in (f"kinds <= {GROUP}", f"kinds > {GROUP}"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, ids, tkeys, low, sent in _anchors(batches, units, window, gram):
            who = rule.name(ids, tkeys, low)
            at = np.flatnonzero(holds(few.value, _occurrence(found.lane1, who)))
            if len(at):
                parts = [sent[a:z + window].tobytes() for a, z in zip(found.low[at], found.high[at])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at]), pa.array(tkeys[at]), pa.array(low[at].astype(np.int32)),
                    pa.array((found.high - found.low + 1)[at].astype(np.int32)), pa.array(signed(found.gram[at])),
                    pa.array(who[at]), pa.array(parts, pa.binary())],
                    names=["id", "tkey", "low", "count", "gram", "who", "units"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, ids, tkeys, low, _ in _anchors(batches, units, window, gram):
            who = rule.name(ids, tkeys, low)
            at = np.flatnonzero(holds(many.value, _occurrence(found.lane1, who)))
            if not len(at):
                continue
            count = (found.high - found.low + 1)[at]
            owner = np.repeat(at, count)
            shift = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            hashes = found.windows(found.low[owner] + shift)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[owner]), pa.array(tkeys[owner]), pa.array((low[owner] + shift).astype(np.int32)),
                pa.array(who[owner]), *(pa.array(signed(h)) for h in hashes)],
                names=["id", "tkey", "low", "who", "hash1", "hash2"])

    compared = body.mapInArrow(whole, f"{MARK}, gram long, who long, units binary") \
        .groupBy("gram").applyInArrow(lambda t: _compare(t, window, rule, width), MARK)
    windows = materialise(body.mapInArrow(
        single, "id long, tkey long, low int, who long, hash1 long, hash2 long"), "windows")
    seen = windows.groupBy("hash1", "hash2").agg(*map(F.expr, rule.windows)).filter(rule.window)
    hashed = windows.join(seen, ["hash1", "hash2"]).filter(rule.later).select(*NAME, "low", F.lit(1).alias("count"))
    again = found.select(*NAME, "low", "count", *LANES, "who") \
        .join(contexts.filter(rule.repeated).select(*LANES, "one"), LANES).filter(rule.member) \
        .select(*NAME, "low", "count")
    return again.unionByName(compared).unionByName(hashed)


def same_text(left: DataFrame, right: DataFrame) -> Column:
    return (left["id"] == right["id"]) & (left["tkey"] == right["tkey"])


def cut(texts: DataFrame, found: DataFrame, units: Units, window: int,
        kept: Callable[[bytes, np.ndarray | None], bytes]) -> DataFrame:
    """Every text with its marked windows taken out: ``id, n_units, n_removed, n_spans, kept, row``.

    ``kept`` builds the rest from a text's bytes and the flags of its removed units, None where none is. Texts
    that no mark can belong to, as flags of their hashes show, are not shuffled.
    """
    listed = materialise(found.groupBy(*NAME).agg(F.collect_set(F.struct("low", "count")).alias("spans")), "spans")
    bits = texts.sparkSession.sparkContext.broadcast(flags(listed.select("tkey"), column_hashes, 1))

    @F.arrow_udf("boolean")
    def listed_text(tkeys: pa.Array) -> pa.Array:
        return pa.array(holds(bits.value, tkeys.to_numpy().view(U64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_units, n_removed, n_spans, rest = [], [], [], []
            for first, last, data, offsets in slices(batch.column(1)):
                bounds = units(data, offsets)[1]
                whole = data.tobytes()
                sizes = np.diff(bounds)
                for number, entry in enumerate(batch.column(2).slice(first, last - first).to_pylist()):
                    size = int(sizes[number])
                    gone = None
                    if entry:
                        start = np.array([e["low"] for e in entry], np.int64)
                        end = start + np.array([e["count"] for e in entry], np.int64) - 1 + window
                        gone = cover(size, start, end)
                    n_units.append(size)
                    n_removed.append(0 if gone is None else int(gone.sum()))
                    n_spans.append(0 if gone is None else int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                    rest.append(kept(whole[offsets[number]:offsets[number + 1]], gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_units, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(rest, pa.binary()), batch.column(3)],
                names=["id", "n_units", "n_removed", "n_spans", "kept", "row"])

    told = texts.withColumn("listed", listed_text("tkey"))
    marked = told.filter("listed")
    joined = marked.join(listed, same_text(marked, listed), "left").select("given", "text", "spans", "row")
    plain = told.filter("NOT listed").select(
        "given", "text", F.lit(None).cast("array<struct<low: int, count: int>>").alias("spans"), "row")
    schema = StructType.fromDDL("id long, n_units long, n_removed long, n_spans long, kept binary") \
        .add("row", texts.schema["row"].dataType)
    return plain.unionByName(joined).mapInArrow(run, schema)
