"""Dedup of bytes of strings that occur more than once: anchors and content hashes in place of bucket-pointer refinement.

Suffixes are not sorted to their ends: two of them matter to each other only if they share ``window`` bytes.
Initial buckets are those of the q-grams, with ``q`` half a window, at content-chosen anchors: a string that
repeats repeats its anchor, at the same place inside. A merged sketch ends the buckets of one member at once.
A bucket is then refined by the identifiers of all later offsets that its members' strings reach, taken
together as one identifier of the context: hashes of content stand for ranks, so a task refines its own places
without looking others up, and Spark's grouping by identifier takes the place of the sort that separates
buckets. Members that still agree repeat as a whole. Buckets that the refinement splits are refined once more,
place by place, by the identifiers of the single strings of their members, in one task or, for large buckets,
by another grouping.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.repeats import Anywhere, byte_units, cut, marks, named_texts


def _kept_bytes(text: bytes, gone: np.ndarray | None) -> bytes:
    return text if gone is None else np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeated_bytes(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = 400) -> DataFrame:
    """Take every byte out that a string of ``window`` bytes covers which also starts anywhere else.

    Returns one row per row of ``df``: ``key, n_bytes, n_removed, n_spans, kept``, the remaining bytes, which
    need not be valid UTF-8. Strings never cross texts, may overlap and are judged on the input; repeated rows
    are separate places, so both lose what they share. Null texts are empty, null ids are kept, texts shorter
    than ``window`` bytes lose nothing. Other columns are not read.
    """
    texts = named_texts(df, text, key)
    found = marks(texts, byte_units, window, max(1, window // 2), Anywhere)
    return cut(texts, found, byte_units, window, _kept_bytes).select(
        F.col("id").alias(key), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept")
