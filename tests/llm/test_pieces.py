"""Sampled segmentations against their exact distribution, and exact round trips."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from tillflow.llm import pieces
from tillflow.llm.pieces import decode, decode_pieces, draw_samples, encode_samples
from tillflow.llm.units import U64

TEXTS = ["in to", "ab", "", " ", "  two  spaces ", "line\n\nnext\tcell\r", "é ß 日本 🙂", "a▁b", "x" * 3000, "The state of the art.",
         "lowercase UPPER 1234 #@!", "\u0000odd​", "ﬁ Ａ"]


def segmentations(text: str, words: pieces.Vocabulary):
    """All segmentations of a short text with their probabilities."""
    def go(rest):
        if not rest:
            return [((), 0.0)]
        found = []
        for n in range(1, len(rest) + 1):
            if rest[:n] in words.ids:
                found += [((words.ids[rest[:n]], *tail), words.log_prob[rest[:n]] + log) for tail, log in go(rest[n:])]
        return found
    every = go("▁" + text.replace(" ", "▁"))
    total = np.logaddexp.reduce([log for _, log in every])
    return {path: math.exp(log - total) for path, log in every}


def drawn(texts, keys, samples, lattices=None):
    lattices = lattices or pieces.Lattices(pieces.vocabulary(pieces.MODEL))
    found, threshold = draw_samples(lattices, texts, keys, samples)
    out = [[] for _ in texts]
    for rows, path in found:
        size = lattices.emit_size.all[path.edge]
        ids = lattices.emit.all[pieces._spread(lattices.emit_at.all[path.edge], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[path.bounds]
        for k, row in enumerate(rows):
            out[row].append((tuple(ids[ends[k]:ends[k + 1]].tolist()), path.log_prob[k], path.top[k], threshold[row]))
    return out


def test_samples_follow_the_distribution(monkeypatch):
    words = pieces.vocabulary(pieces.MODEL)
    flat = {p: -1.0 * len(p) ** 0.3 for p in words.log_prob}
    monkeypatch.setattr(words, "log_prob", flat)
    monkeypatch.setattr(words, "weight", np.where(words.piece >= 0, [-1.0 * max(1, n) ** 0.3 for n in
                                                                     _lengths(words)], 0.0))
    exact = segmentations("in to", words)
    n = 6000
    got = drawn(["in to"] * n, np.arange(n).astype(U64) * U64(977), 3, pieces.Lattices(words))
    first = Counter(s[0][0] for s in got)
    second = Counter(s[1][0] for s in got)
    for path, p in exact.items():
        assert abs(first[path] / n - p) < 0.03
        after = sum(q / (1 - q) * p for other, q in exact.items() if other != path)
        assert abs(second[path] / n - after) < 0.03
    for row in got:
        assert len({s[0] for s in row}) == len(row) == 3
        assert row[0][2] >= row[1][2] >= row[2][2] >= row[0][3]
        assert all(abs(s[1] - math.log(exact[s[0]])) < 1e-6 for s in row)
    # Inverse inclusion probabilities weigh the samples into an unbiased total of one.
    total = np.mean([sum(math.exp(s[1]) / -math.expm1(-math.exp(s[1] - s[3])) for s in row) for row in got])
    assert abs(total - 1) < 0.03


def _lengths(words):
    by_id = {number: len(piece) for piece, number in words.ids.items()}
    return [by_id.get(int(number), 0) for number in words.piece]


def test_all_segmentations_come_once():
    exact = segmentations("ab", pieces.vocabulary(pieces.MODEL))
    got = drawn(["ab"], np.array([5], U64), 50)[0]
    assert {s[0] for s in got} == set(exact) and len(got) == len(exact)


def test_round_trip_and_batches(spark):
    rows = [(n, text, "x", 7) for n, text in enumerate(TEXTS)] + [(50, None, "x", 7), (None, "no key", "x", 7), (0, TEXTS[0], "x", 7)]
    schema = "doc_id long, text string, pieces string, sample int"
    one = encode_samples(spark.createDataFrame(rows, schema).coalesce(1), samples=3)
    many = encode_samples(spark.createDataFrame(rows, schema).repartition(7), samples=3)
    got = decode(one).collect()
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
    given = {i: t or "" for i, t, *_ in rows}
    assert all(r["text"] == given[r["doc_id"]] for r in got)
    assert {r["doc_id"] for r in got} == set(given)
    assert all(0 < r["inclusion"] <= 1 for r in got)
    assert encode_samples(spark.createDataFrame([], schema)).collect() == []


def test_decode_like_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for t in TEXTS if "▁" not in t and t.strip()]
    ids = [model.encode(t) for t in texts]
    assert decode_pieces(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [model.decode(i) for i in ids]
