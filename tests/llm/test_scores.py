"""License scans, language models, quality, mixing and search against plain definitions."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tillflow.llm import neighbours, quality, toxicity
from tillflow.llm.license_rules import BASE, RULES
from tillflow.llm.license_scan import label_digest, scan_licenses, scan_text, suppress
from tillflow.llm.mixing import mix_sources, targets
from tillflow.llm.neighbours import search
from tillflow.llm.quality import score_quality
from tillflow.llm.toxicity import score_toxicity

CLASH = "doc_id long, text string, score double, labels string, predicted int, size int, row string, fold int"


def frame(spark, rows, schema=CLASH):
    return spark.createDataFrame([(*r, *[None] * (len(schema.split(",")) - len(r))) for r in rows], schema)


def base_places(text):
    words = brute.ALNUM.findall(brute.lower(text or ""))
    found = []
    for phrase, label in BASE.items():
        parts = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k:k + len(parts)] == parts]
    return len(words), found


def test_base_phrases_against_definition(spark):
    rnd = random.Random(3)
    words = ["cc", "by", "CC-BY", "General", "public", "license", "all", "RIGHTS", "reserved", "x", "é", "4.0", "\n", "_"]
    rows = [(n, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for n in range(60)]
    rows += [(100, None), (101, ""), (None, "cc by"), (102, "ccby"), (103, "cc by " * 3000), (103, "cc by " * 3000)]
    got = label_digest(scan_licenses(frame(spark, rows))).collect()
    want = []
    for i, text in rows:
        n, found = base_places(text)
        at = [k for k, _ in found]
        want.append((i, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in found}))))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_rules_and_suppression():
    assert len(RULES) > 300 and all(r.keyword in r.pattern.replace("licen[sc]e", "license") or r.label for r in RULES)
    labels = {d[2] for d in scan_text(b"Licensed under the Apache License, Version 2.0")[1]}
    assert "apache-2.0" in labels and "gpl" not in labels
    assert {d[2] for d in scan_text(b"SPDX-License-Identifier: GPL-3.0-only")[1]} == {"spdx-gpl-3-0-only"}
    rnd = random.Random(4)
    for _ in range(200):
        found = [(a, a + rnd.randint(0, 5), rnd.choice("xyz"), rnd.choice([10, 20, 30])) for a in
                 (rnd.randint(0, 8) for _ in range(rnd.randint(0, 9)))]
        kept = suppress(found)
        for d in set(found):
            inside = [o for o in set(found) if o != d and o[0] <= d[0] and o[1] >= d[1] and o[3] >= d[3]
                      and (o[:2] != d[:2] or o[3] > d[3] or o[2] < d[2])]
            assert (d in kept) == (not inside)




def plain_model(texts):
    """Kneser-Ney by definition: probability of a letter after a context, by class."""
    top = Counter()
    for text, kind in texts:
        units = letters_of(text)
        for k in range(len(units) - toxicity.ORDER + 1):
            top[units[k:k + toxicity.ORDER], kind] += 1
    tables = {}
    counts = top
    for size in range(toxicity.ORDER, 0, -1):
        if size == toxicity.OWN_ORDER - 1:
            merged = Counter()
            for (run, _), n in counts.items():
                merged[run, -1] += n
            counts = merged
        total, kinds = defaultdict(int), defaultdict(int)
        for (run, kind), n in counts.items():
            total[run[:-1], kind] += n
            kinds[run[:-1], kind] += 1
        tables[size] = (counts, total, kinds)
        counts = Counter((run[1:], kind) for run, kind in counts)

    def probability(run, kind):
        if not run:
            return 1 / 256
        own = kind if len(run) >= toxicity.OWN_ORDER else -1
        counts, total, kinds = tables[len(run)]
        below = probability(run[1:], kind)
        if not total[run[:-1], own]:
            return below
        seen = counts.get((run, own), 0)
        return (max(seen - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * kinds[run[:-1], own] * below) / total[run[:-1], own]
    return probability


def letters_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    units, bounds = toxicity._units(data, np.array([0, len(data)]))
    return bytes(units)


def test_letters():
    for text in ("Ab, c", "", "  a", "a  ", "é!1x"):
        expected = brute.lower(text).encode()
        expected = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in expected)
        while b"  " in expected:
            expected = expected.replace(b"  ", b" ")
        assert letters_of(text).strip(b" ") == expected.strip(b" ")


def test_kneser_ney_against_definition(spark):
    rnd = random.Random(5)
    syllables = ["ba", "na", "mo", "ro", "idi", "ot"]
    texts = [(" ".join("".join(rnd.choice(syllables[:4 + 2 * kind]) for _ in range(rnd.randint(1, 3)))
                       for _ in range(rnd.randint(3, 30))), kind) for kind in (0, 1) for _ in range(15)]
    top = toxicity.count_runs(spark.createDataFrame(texts, "text string, class int").repartition(3))
    model = tuple(toxicity.layout(t, m) for t, m in zip(toxicity.tables(top), (0.0, 1.0)))
    probability = plain_model(texts)
    units = letters_of("banana moro idiot xyz moroba")
    ratios = toxicity.log_ratios(np.frombuffer(units, np.uint8), *model)
    for k in range(toxicity.ORDER - 1, len(units)):
        run = units[k - toxicity.ORDER + 1:k + 1]
        assert ratios[k] == pytest.approx(math.log(probability(run, 1) / probability(run, 0)), abs=2e-4)


def test_no_run_is_lost(spark):
    runs = 3_000_000
    table = toxicity.layout(spark.range(runs).selectExpr(
        "6 AS size", "cast(id % 2 AS int) AS class", "id AS run", "1L AS n", "cast(id % 7 + 1 AS double) AS value"), 0.0)
    number = np.arange(runs + 1000, dtype=np.uint64)
    found = table.look(toxicity._hash(number, 6))
    want = np.zeros((runs + 1000, 2))
    want[np.arange(runs), np.arange(runs) % 2] = np.arange(runs) % 7 + 1
    assert (found == want).all()


def test_shards_score_as_one(spark):
    docs, labels = labelled(120, 8, lambda: "idiot")
    kind = {i: k for i, k, _ in labels if k in (0, 1)}
    texts = spark.createDataFrame([(t, kind[i]) for i, t in docs if i in kind and t], "text string, class int")
    top = toxicity.materialise(toxicity.count_runs(texts), "runs")
    one, many = toxicity.build(top), toxicity.build(top, 300)
    assert len(one) == 1 and len(many) > 2
    column = pa.array([t for _, t in docs] + ["unseen zzyzx words", "a"])
    assert toxicity.describe(column, many) == pytest.approx(toxicity.describe(column, one), abs=1e-9)
    smallest = min(len(t[0].records) for t in many)
    assert smallest < 0.7 * len(next(iter(one))[0].records)


def labelled(n, seed, mark):
    rnd = random.Random(seed)
    words = ["the", "river", "stone", "cloud", "walked", "under", "seven", "market", "lamp", "winter"]
    docs, labels = [], []
    for i in range(n):
        kind = int(rnd.random() < 0.4)
        text = [rnd.choice(words) for _ in range(rnd.randint(10, 80))]
        if kind:
            for _ in range(max(1, len(text) // 12)):
                text[rnd.randrange(len(text))] = mark()
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, kind, 1 - kind))
    docs += [(n, None), (n + 1, ""), (None, "stone lamp"), (n + 2, "lamp " * 5000), (3, docs[3][1])]
    return docs, labels + [(None, 1, 1), (5, None, None), (6, 7, 7)]


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_held_out(spark):
    rnd = random.Random(6)
    docs, labels = labelled(500, 1, lambda: rnd.choice(["idiot", "moron", "scum"]) + rnd.choice(["", "s", "ish"]))
    got = score_toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int, score int")).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in got)
    kind = {i: k for i, k, _ in labels if k in (0, 1)}
    test = [(kind[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in kind]
    assert sum(a == b for a, b in test) >= 0.95 * len(test)


def test_quality_held_out(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 300)
    rnd = random.Random(7)
    docs, labels = labelled(500, 2, lambda: rnd.choice(["###", "|", "%%$$", "WOW!!"]))
    got = score_quality(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    kind = {i: k for i, _, k in labels if k in (0, 1)}
    test = [(kind[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in kind]
    assert sum(a == b for a, b in test) >= 0.95 * len(test)


def test_machine_is_its_pairwise_sum():
    rng = np.random.default_rng(1)
    machine = quality.Machine(np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    machine.weight = rng.normal(size=quality.N_FEATURES)
    feature, value = np.array([3, 8, 21]), rng.normal(size=3)
    margin = machine.margin(1, np.zeros(3, int), feature, value)[0][0]
    want = machine.weight[feature] @ value + sum(
        machine.vector[feature[a]] @ machine.vector[feature[b]] * value[a] * value[b] for a in range(3) for b in range(a))
    assert margin == pytest.approx(want)


@pytest.mark.parametrize("score,column", [(score_toxicity, "toxic"), (score_quality, "quality")])
def test_scores_without_labels_or_rows(spark, score, column):
    labels = spark.createDataFrame([], f"doc_id long, {column} int")
    assert len(score(frame(spark, [(1, "a b"), (2, None)]), labels).collect()) == 2
    assert score(frame(spark, []), labels).collect() == []


def filled(totals, weights, share=1.5):
    """Targets by the definition: share by weight, cap, reshare the excess until none is above."""
    want, free = {}, dict(totals)
    pot = share * sum(totals.values())
    while free:
        heavy = sum(weights[s] for s in free)
        over = [s for s in free if pot * weights[s] / heavy > 2 * totals[s]]
        if not over:
            return want | {s: pot * weights[s] / heavy for s in free}
        for s in over:
            want[s] = 2 * totals[s]
        pot -= sum(want[s] for s in over)
        free = {s: t for s, t in free.items() if s not in over}
    return want


def test_mixing(spark):
    rnd = random.Random(8)
    names = ["a", "B", "ä", None, "c", "", "z"]
    rows = [(n, " ".join("w" * 1 for _ in range(int(rnd.paretovariate(1.2) * 5))), rnd.choice(names[:3] * 3 + names))
            for n in range(1500)]
    rows += [(9000, None, "a"), (9001, "", None), (None, "x y", "a"), (7, rows[7][1], rows[7][2])]
    schema = "doc_id long, text string, source string, size int, taken string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = mix_sources(df.repartition(4), carry=True).collect()
    again = mix_sources(df.repartition(9), carry=True).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    total = Counter()
    for _, text, source in rows:
        total[source] += len((text or "").split())
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    want = filled(dict(total), {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    taken = Counter()
    for r in got:
        source = r["row"]["source"]
        taken[source] += r["taken"]
        assert r["source_size"] == total[source] and r["target"] == pytest.approx(want[source])
        assert r["size"] == len((r["row"]["text"] or "").split()) and r["taken"] <= 2 * r["size"]
    for source in want:
        assert abs(taken[source] - want[source]) <= 0.02 * want[source] + 5
    assert mix_sources(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("part_rows", [10_000, 64])
def test_search_recall(spark, monkeypatch, part_rows):
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    monkeypatch.setattr(neighbours, "CHUNK", 300)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    data = base[rng.integers(0, 40, 1200)] + 0.4 * rng.normal(size=(1200, 16))
    data[100:110] = data[100]
    rows = [(n, v.tolist()) for n, v in enumerate(data)]
    bad = [(2000, None), (2100, [0.0] * 16), (2200, [None] * 16), (2300, [float("nan")] * 16), (None, [1.0] * 16), (2400, [1.0])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows + bad], "vec_id long, embedding array<double>, score double, rank int")
    got = defaultdict(list)
    for r in search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for query in range(0, 1200, 100):
        distance = np.sqrt(((data - data[query]) ** 2).sum(axis=1))
        distance[query] = np.inf
        order = np.lexsort((np.arange(1200), distance))[:10]
        assert [s for _, s in got[query]] == sorted(s for _, s in got[query])
        assert all(s == pytest.approx(distance[v], rel=1e-14) for v, s in got[query])
        hits += len({v for v, _ in got[query]} & set(order.tolist()))
    assert set(got) == set(range(0, 1200, 100)) and hits >= 0.9 * 120
    assert search(df.filter("false")).collect() == []


def test_partition_is_balanced():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, 8))
    near = neighbours.nearest(rows, rows, 8, True)
    part = neighbours.partition(rows, near, 3)
    assert sorted(np.bincount(part)) == [50] * 8
    same = (part[near] == part[:, None]).mean()
    assert same > 2 * (part[near] == rng.permutation(part)[:, None]).mean()


def test_null_column_types():
    assert quality.extract(np.zeros(0, np.uint8), np.array([0, 0]), np.array([-1.0]))[3].shape == (1, quality.N_STATS)
    assert toxicity.describe(pa.array([], pa.string()), None).shape == (4, 0)
