"""License scans: ordered signature rules behind a keyword prefilter.

The words of a text, lower-cased and joined by single spaces, are read once by an automaton of the rules'
keywords; only rules whose keyword stands in the text run. A detection that lies inside another one of at
least its priority is suppressed, so the strongest, widest statement of each place remains.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.batches import bounded
from tillflow.llm.license_rules import BASE, BASE_PRIORITY, RULES
from tillflow.llm.units import ALNUM, LOWER

SCHEMA = ("id long, n_words long, detections array<struct<label: string, first: long, last: long, "
          "priority: int, base: boolean>>")
_ARROW = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("detections", pa.list_(pa.struct([
    ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()),
    ("base", pa.bool_())])))])

#: Lower-cases and turns every byte outside words into a space.
_CLEAN = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))


@lru_cache(maxsize=1)
def _machine() -> tuple[ahocorasick.Automaton, list[tuple[re.Pattern, str, int]]]:
    """The keyword automaton, whose values are rule numbers, and the compiled rules."""
    by_keyword = defaultdict(list)
    compiled = []
    for number, rule in enumerate(RULES):
        by_keyword[rule.keyword].append(number)
        compiled.append((re.compile(rf" (?:{rule.pattern})(?= )".encode()), rule.label, rule.priority))
    automaton = ahocorasick.Automaton()
    for keyword, numbers in by_keyword.items():
        automaton.add_word(keyword, numbers)
    automaton.make_automaton()
    return automaton, compiled


def suppress(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections ``(first, last, label, priority)`` that no other one of at least their priority contains.

    Of equal intervals the higher priority stays, then the smaller label.
    """
    found = sorted(set(found), key=lambda d: (d[0], -d[1], -d[3], d[2]))
    reach: dict[int, int] = {}
    kept = []
    for detection in found:
        _, last, _, priority = detection
        if all(end < last for level, end in reach.items() if level >= priority):
            kept.append(detection)
        reach[priority] = max(reach.get(priority, -1), last)
    return kept


def scan_text(text: bytes) -> tuple[int, list[tuple[int, int, str, int, bool]]]:
    """Word count and detections of one text: the base phrases, all of them, and the rules' that stay."""
    words = text.translate(_CLEAN).split()
    flat = b" " + b" ".join(words) + b" "
    automaton, compiled = _machine()
    base = []
    for phrase, label in BASE.items():
        sought = f" {phrase} ".encode()
        at = flat.find(sought)
        while at >= 0:
            base.append((at, at + len(sought) - 1, label))
            at = flat.find(sought, at + 1)
    hits: set[int] = set()
    for _, numbers in automaton.iter(flat.decode("latin-1")):
        hits.update(numbers)
    found = [(m.start(), m.end(), compiled[n][1], compiled[n][2])
             for n in sorted(hits) for m in compiled[n][0].finditer(flat)]
    if not base and not found:
        return len(words), []
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)

    def word(at: int) -> int:
        return int(np.searchsorted(spaces, at))

    out = [(word(a), word(z) - 1, label, BASE_PRIORITY, True) for a, z, label in base]
    out += [(first, last, label, priority, False)
            for first, last, label, priority in suppress([(word(a), word(z) - 1, b, p) for a, z, b, p in found])]
    return len(words), sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, detections = [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            n_words, found = scan_text(text or b"")
            counts.append(n_words)
            detections.append([dict(zip(("first", "last", "label", "priority", "base"), d)) for d in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(detections, _ARROW.field(2).type)],
            schema=_ARROW)


def scan_licenses(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_words`` and all ``detections`` with their word places.

    Base phrases are detected at every place and never suppressed. A null or empty text has no words and no
    detections; null ids and repeated rows are kept as they come. Other columns are not read.
    """
    return bounded(df).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(_scan, SCHEMA)


def label_digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, places, labels and a confidence per document; see :func:`scan_licenses`.

    ``score`` is the highest priority found divided by 100, 0 without detections.
    """
    base = F.filter("detections", lambda d: d["base"])

    def labels(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")

    return scanned.select(
        F.col("id").alias(key), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])) / 100.0, F.lit(0.0))
        .alias("score"))
