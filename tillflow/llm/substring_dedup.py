"""Substring dedup: a count-min prefilter, then exact groups of the windows estimated repeated.

A window is a run of consecutive words of one text. Each task adds its windows, through the anchors that stand
for them, to a sketch of saturating counters; the sketches are merged. A window occurs at most as often as its
anchor, and a sketch never underestimates, so every repeated window passes. The second pass groups what passed
by 128-bit hashes of whole contexts and, where contexts differ, compares them exactly.

The sketch has a fixed size. Beyond it, more unique anchors pass and are grouped too: the result is the same,
and as only about two anchors in ``window - gram + 2`` words are shuffled, so is the order of the cost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.repeats import Earlier, cut, marks, named_texts, word_units


def _kept_words(text: bytes, gone: np.ndarray | None) -> bytes:
    words = text.split()
    if gone is not None:
        words = [words[at] for at in np.flatnonzero(~gone)]
    return b" ".join(words)


def _kept_text(text: bytes, gone: np.ndarray | None) -> bytes:
    return text if gone is None else _kept_words(text, gone)


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = 50,
                   carried: list[str] | None = None, keep_form: bool = False) -> DataFrame:
    """Take every word out that a window covers whose words also start in a text with a smaller id.

    Returns one row per row of ``df``: ``key, n_words, n_removed, n_spans, kept``, the kept words joined by one
    space, and a struct ``row`` of the columns to carry along (the id where none are named). With ``keep_form``
    a text that loses nothing stays as it is. Windows are judged on the input. Null and empty texts, and texts
    of fewer than ``window`` words, lose nothing; rows with equal ids do not count against each other; a null
    id counts as the largest. Other columns are not read.
    """
    texts = named_texts(df, text, key, carried)
    found = marks(texts, word_units, window, max(1, window * 3 // 10), Earlier)
    return cut(texts, found, word_units, window, _kept_text if keep_form else _kept_words).select(
        F.col("id").alias(key), F.col("n_units").alias("n_words"), "n_removed", "n_spans",
        F.col("kept").cast("string").alias("kept"), "row")
