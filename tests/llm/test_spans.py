"""Duplicate spans of words and bytes against their definitions."""

from __future__ import annotations

import random

import pytest

from tests.llm import brute
from tillflow.llm import repeats
from tillflow.llm.substring_dedup import remove_repeats
from tillflow.llm.suffix_dedup import remove_repeated_bytes

SCHEMA = "doc_id long, text string, kept string, n_words int"


def texts(seed: int, letters: int) -> list[tuple[int | None, str | None]]:
    """Random texts with shared, shifted and repeated passages, copies, nulls, empties and one long text."""
    rnd = random.Random(seed)
    passages = [[rnd.choice("abcdefgh"[:letters]) * rnd.randint(1, 2) for _ in range(rnd.randint(8, 60))]
                for _ in range(6)]
    out: list[tuple[int | None, str | None]] = []
    for number in range(40):
        words: list[str] = []
        for _ in range(rnd.randint(0, 4)):
            part = rnd.choice(passages)
            low = rnd.randint(0, len(part) // 2)
            words += part[low:rnd.randint(low, len(part))]
            words += [rnd.choice("uvwxyzéß") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 5))]
        out.append((number, rnd.choice([" ", "\n", "  "]).join(words)))
    out += [(40, None), (41, ""), (42, " \t"), (None, out[3][1]), (None, out[3][1]), (5, out[7][1]), (6, out[6][1])]
    out += [(43, "a " * 400), (44, " ".join(rnd.choice("abc") for _ in range(3000))), (45, out[-1][1])]
    rnd.shuffle(out)
    return out


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(parts)


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed,letters,window,group", [(1, 2, 6, 8192), (2, 8, 8, 2), (3, 4, 5, 0), (4, 8, 20, 8192)])
def test_words_against_definition(spark, monkeypatch, seed, letters, window, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = texts(seed, letters)
    got = remove_repeats(frame(spark, rows), window=window).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert ordered(tuple(r) for r in got) == ordered(brute.word_dedup(rows, window))


@pytest.mark.parametrize("seed,letters,window,group", [(1, 2, 12, 8192), (2, 8, 16, 3), (3, 4, 52, 0), (5, 8, 9, 8192)])
def test_bytes_against_definition(spark, monkeypatch, seed, letters, window, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = texts(seed, letters)
    got = remove_repeated_bytes(frame(spark, rows), window=window).collect()
    want = brute.byte_dedup(rows, window)
    assert ordered((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == ordered(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(none).collect() == []
    assert remove_repeated_bytes(none).collect() == []
    blank = spark.createDataFrame([(None, None, None, None)], SCHEMA)
    assert [tuple(r)[:3] for r in remove_repeats(blank).collect()] == [(None, 0, 0)]
