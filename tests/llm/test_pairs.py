"""Similar documents and vectors against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import brute
from tillflow.llm import jaccard_join, vector_dedup
from tillflow.llm.jaccard_join import join_similar
from tillflow.llm.vector_dedup import link_vectors

SCHEMA = "doc_id long, text string, n_shingles int, component_id string"


def documents(seed: int) -> list[tuple[int | None, str | None]]:
    """Groups of near copies of all degrees, chains, shared passages, short texts, copies, nulls."""
    rnd = random.Random(seed)
    words = [f"w{n}" for n in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    out: list[tuple[int | None, str | None]] = []
    number = 0
    for _ in range(8):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 90))]
        for _ in range(rnd.randint(1, 7)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            if rnd.random() < 0.3:
                copy = copy[rnd.randint(0, 4):]
            if rnd.random() < 0.3:
                base = copy
            out.append((number, (" ".join(copy)).upper() if rnd.random() < 0.2 else "\t".join(copy)))
            number += 1
    for _ in range(12):
        out.append((number, " ".join(passage + [rnd.choice(words) for _ in range(rnd.randint(5, 40))])))
        number += 1
    out += [(number + k, t) for k, t in enumerate(["a b c", "A b  c", "a b", "a b c d e", "", None, " \n", "é ß", "É ß"])]
    out += [(None, out[0][1]), (None, "only here nowhere else at all"), (2, out[5][1]), (2, out[5][1])]
    rnd.shuffle(out)
    return out


def expected(rows):
    sets = [brute.shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute.components(links, len(rows))
    least: dict[int, int] = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, root)), key=repr)


@pytest.mark.parametrize("seed,rounds", [(1, 2), (2, 1), (3, 0)])
def test_documents_against_brute_force(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = documents(seed)
    got = join_similar(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3))
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == expected(rows)


def test_no_documents(spark):
    assert join_similar(spark.createDataFrame([], SCHEMA)).collect() == []


def vectors(seed: int) -> list[tuple[int | None, list[float | None] | None]]:
    random_state = np.random.default_rng(seed)
    out: list[tuple[int | None, list[float | None] | None]] = []
    for group in range(12):
        base = random_state.normal(size=64)
        for _ in range(int(random_state.integers(1, 9))):
            noise = random_state.normal(size=64) * random_state.choice([0.0, 0.1, 0.2, 0.35])
            out.append((len(out), (float(random_state.choice([1.0, 3.0])) * (base + noise)).tolist()))
    plain = [1.0] + [0.0] * 63
    return out + [(200, None), (201, [0.0] * 64), (202, [None] + plain[1:]), (203, [float("nan")] + plain[1:]),
                  (204, [float("inf")] + plain[1:]), (205, plain), (206, plain), (None, plain), (207, [1.0, 2.0]),
                  (208, [1e200] + [0.0] * 63)]


@pytest.mark.parametrize("seed", [1, 2])
def test_vectors_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rows = vectors(seed)
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and len(v) == 64 and None not in v
            and np.isfinite(v).all() and any(v)]
    unit = vector_dedup.unit(np.array([rows[k][1] for k in good]))
    close = unit @ unit.T >= 0.9
    links = [(a, b) for a in range(len(good)) for b in range(a) if close[a, b]]
    root = brute.components([(good[a], good[b]) for a, b in links], len(rows))
    want = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            want[i] = (int(close[good.index(k)].sum()) - 1 if k in good else 0, rows[root[k]][0])
    got = link_vectors(spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, n_links int"))
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()}
    assert found.pop(None) == (0, None)
    missed = sum(want[i][0] - found[i][0] for i in want)
    assert all(found[i][0] <= want[i][0] for i in want)
    assert missed <= 0.02 * sum(w[0] for w in want.values())
    if not missed:
        assert found == want


@pytest.mark.parametrize("mean,shard_rows", [(0.0, 1 << 15), (1.0, 1 << 15), (1.0, 100)])
def test_no_link_at_the_limit_is_lost(spark, monkeypatch, mean, shard_rows):
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", shard_rows)
    random_state = np.random.default_rng(9)
    common = mean * np.ones(64)
    rows = np.concatenate([common + random_state.normal(size=(1, 64)) + random_state.normal(size=(4, 64)) * (0.33 + 0.1 * mean)
                           for _ in range(150)])
    unit = vector_dedup.unit(rows)
    close = unit @ unit.T >= 0.9
    root = brute.components([(a, b) for a, b in np.argwhere(np.tril(close, -1)).tolist()], len(rows))
    got = link_vectors(spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>"))
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()}
    assert close.sum() - len(rows) > 100
    assert found == {i: (int(close[i].sum()) - 1, root[i]) for i in range(len(rows))}


def test_counts_of_the_sketch_stay_in_the_tasks(spark, monkeypatch):
    """The driver gets one byte per cell, and the levels are those of all counts taken together."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(" ".join(f"w{(n * k) % 97}" for k in range(40)),) for n in range(60)] + [("same five words in here",)] * 300
    texts = spark.createDataFrame(rows, "text string").repartition(5)
    hits = np.zeros(1 << jaccard_join.LEVEL_BITS, np.int64)
    import pyarrow as pa

    for _, _, shingles in jaccard_join.shingle_sets(pa.array([t for t, in rows]), 5):
        np.add.at(hits, jaccard_join._cell(shingles), 1)
    mean = hits.mean()
    wanted = np.log2(1 + np.maximum(hits - mean, 0) / (1 + 2 * np.sqrt(mean))).astype(np.uint8)
    sizes, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: [sizes.append(sum(len(v) for v in r if isinstance(v, bytes | bytearray))) or r for r in collect(self)])
    assert (jaccard_join.levels(texts, 5) == wanted).all()
    assert 0 < sum(sizes) <= 1 << jaccard_join.LEVEL_BITS
