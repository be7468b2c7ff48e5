"""The stages in order: what each keeps, against its definition on its own input."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_scores import labelled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(12)
    docs, labels = labelled(260, 3, lambda: rnd.choice(["idiot", "moron", "scum"]))
    vocabulary = [f"word{n}" for n in range(3000)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(70))
    more = []
    for n in range(120):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 120))]
        if n % 4 == 0:
            text[3:3] = passage.split()
        more.append((1000 + n, " ".join(text)))
        if n % 5 == 0:
            more.append((2000 + n, " ".join(text[:-1] + ["other"])))
        if n % 7 == 0:
            more.append((3000 + n, " ".join(text)))
    rows = [(i, t, "en", rnd.choice(["a", "b", None]), len(t or "")) for i, t in docs + more]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    rows, labels = corpus
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    out = {"input": (docs.columns, [tuple(r) for r in docs.collect()])}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        out[name] = (docs.columns, [tuple(r) for r in docs.collect()])
    out["run"] = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "encoding"]
    assert all(stages[n][0] == stages["input"][0] for n, _ in corpus_pipeline.STAGES[:-1])


def test_toxic_documents_go(stages):
    kept, given = stages["toxicity"][1], stages["input"][1]
    toxic = [r for r in given if any(w in (r[1] or "") for w in ("idiot", "moron", "scum"))]
    clean = [r for r in given if r not in toxic]
    assert sum(r in kept for r in toxic) <= 0.05 * len(toxic)
    assert sum(r in kept for r in clean) >= 0.97 * len(clean)


def test_one_of_each_group_stays(stages):
    given, kept = stages["toxicity"][1], stages["near_duplicates"][1]
    sets = [brute.shingles(r[1]) for r in given]
    root = brute.components([(a, b) for a in range(len(given)) for b in range(a) if sets[a] and sets[b]
                             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], len(given))
    groups: dict[int, list] = {}
    for r, s, g in zip(given, sets, root):
        if s:
            groups.setdefault(g, []).append(r)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()]
    assert sorted((r[0] for r, s in zip(kept, map(brute.shingles, (r[1] for r in kept))) if s), key=repr) == sorted(want, key=repr)
    assert sum(not brute.shingles(r[1]) for r in kept) == len({r[:2] for r, s in zip(given, sets) if not s})


def test_groups_that_share_an_id_each_keep_one(spark):
    words = [" ".join(f"{mark}{n}" for n in range(60)) for mark in "abcd"]
    near = [text + " end" for text in words]
    rows = [(5, words[0]), (5, words[1]), (9, near[1]), (7, near[0]), (None, words[2]), (None, near[2]), (5, words[3]),
            (5, near[3]), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    kept = [tuple(r)[:2] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert {(5, words[0]), (5, words[1]), (5, ""), (6, None)} <= set(kept) and len(kept) == 6
    assert sum(r in kept for r in rows[4:6]) == sum(r in kept for r in rows[6:8]) == 1


def test_repeated_windows_go(stages):
    given, kept = stages["near_duplicates"][1], {r[0]: r for r in stages["substring_dedup"][1]}
    assert len(kept) == len(given)
    for (i, _, removed, text), r in zip(brute.word_dedup([r[:2] for r in given], 50), given):
        assert kept[i][1] == (text if removed else r[1])
        assert kept[i][4] == (len(text) if removed else r[4]) and kept[i][2:4] == r[2:4]


def test_mix_and_pieces(stages):
    given, mixed = stages["substring_dedup"][1], stages["mixing"][1]
    assert set(mixed) <= set(given) and max(map(mixed.count, set(mixed))) <= 2
    size = {r: len((r[1] or "").split()) for r in given}
    assert sum(size[r] for r in mixed) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
    encoded = stages["encoding"][1]
    assert {r[0] for r in encoded} == {r[0] for r in mixed}
    assert sorted(map(repr, encoded)) == sorted(map(repr, stages["run"]))


def test_names_of_columns_do_not_clash(spark):
    """Columns may be named like what a stage computes; an empty table stays empty."""
    columns = "doc_id long, text string, root long, hash string, row string, text_hash string, `text hash` string, `a.b` int"
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 7, "h", "r", "t", "s", 3), (2, text, 8, "h", "r", "t", "s", 4)], columns)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, 7, "h", "r", "t", "s", 3)]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []
