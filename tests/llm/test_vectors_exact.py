"""Exact scores from residues, and hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tillflow.llm import hard_negatives
from tillflow.llm.hard_negatives import Scorer, mine, moduli, signed

SCHEMA = "vec_id long, embedding array<float>, label int, mark string, place int"


@pytest.mark.parametrize("bound", [1, 5, 1000, 1 << 23, 1 << 40, 1 << 61])
def test_signed_scores_from_residues(bound):
    primes = moduli(bound)
    random = np.random.default_rng(bound % 97)
    values = np.concatenate([np.array([0, 1, -1, bound, -bound, bound - 1, -(bound // 2)], dtype=np.int64),
                             random.integers(-bound, bound, 2000)])
    assert (signed([values % p for p in primes], primes) == values).all()


def test_products_are_exact_beyond_float32():
    random = np.random.default_rng(1)
    a, b = random.integers(-32000, 32000, (30, 3000)), random.integers(-32000, 32000, (40, 3000))
    assert (Scorer(a, b, moduli(3000 * 32000 ** 2))(3, 20) == (a @ b.T)[3:20]).all()


def expected(rows, every, positives, negatives):
    """By definition, in whole numbers of any size."""
    good = {(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and v is not None
            and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)}
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in good]
    out = []
    for i, label, v in good:
        if i % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i]
        for score, j, _ in sorted(o for o in others if o[2] == label)[:positives]:
            kept = sorted(o for o in others if o[2] != label and 30 * -score <= 100 * -o[0] <= 90 * -score)[:negatives]
            out += [(i, j, r + 1, n[1], -score, -n[0]) for r, n in enumerate(kept)]
    return sorted(out)


@pytest.mark.parametrize("cells", [(4096, 8192), (3, 40)])
def test_negatives_against_brute_force(spark, monkeypatch, cells):
    for name, value in zip(("ANCHORS", "ROWS"), cells):
        monkeypatch.setattr(hard_negatives, name, value)
    random = np.random.default_rng(7)
    base = random.normal(0, 1, (4, 6))
    rows = []
    for i in range(300):
        v = (base[i % 4] + random.normal(0, 0.7, 6)).astype(np.float32)
        rows.append((i, [round(float(x), 1) for x in v], int(random.integers(0, 4))))
    rows += [(300, [0.0] * 6, 1), (310, None, 1), (320, [1.0] * 6, None), (330, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1),
             (340, [float("nan")] + [1.0] * 5, 2), (350, [float("inf")] + [1.0] * 5, 2), (360, [1.0] * 5, 2), (None, [1.0] * 6, 2)]
    rows += rows[:30] + [(40, rows[40][1], rows[40][2])] * 90
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], m) for i, v, m in rows]
    found = sorted(tuple(r) for r in mine(df, every=10).collect())
    assert len(found) > 500 and found == expected(rows, 10, 5, 10)


def test_edge_tables(spark):
    assert mine(spark.createDataFrame([], SCHEMA)).collect() == []
    lonely = spark.createDataFrame([(0, [1.0, 2.0], 1, "", 0), (1, [1.0, 2.0], 2, "", 0)], SCHEMA)
    assert mine(lonely).collect() == []
    with pytest.raises(ValueError):
        mine(spark.createDataFrame([(0, [1e30, 1e30], 1, "", 0)], SCHEMA))
