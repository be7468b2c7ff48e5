import random

import pytest
from pyspark.sql import functions as F

from tillflow.functions import lcs
from tillflow.operators import match, product
from tillflow.schema import CATALOGUE
from tillflow.sources.catalogue import append_products


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j, other in enumerate(b):
            new.append(row[j] + 1 if ch == other else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def words(pick, n, letters="abcdeilnorst 5é"):
    return sorted({"".join(pick.choice(letters) for _ in range(pick.choice([1, 3, 8, 12, 20, 63, 64, 65, 90]))).strip() for _ in range(n)} - {""})


def brute(probes, names, top=1, threshold=0.7):
    out = []
    for p in probes:
        scored = [(2 * slow_lcs(p, n) / (len(p) + len(n)), -i, n) for i, n in enumerate(names)]
        good = sorted([s for s in scored if s[0] > threshold], reverse=True)[:top]
        out += [(p, n, round(s, 9)) for s, _, n in good]
    return sorted(out)


def data(seed):
    pick = random.Random(seed)
    names = words(pick, 60)
    near = {n[:i] + pick.choice("abx") + n[i + 1:] for n in names for i in [pick.randrange(len(n))]}
    return sorted(near | set(words(pick, 20)) | {names[0]}), names


def test_lcs_helpers():
    pick = random.Random(3)
    for a, b in zip(words(pick, 40), words(pick, 40)):
        assert lcs.lcs_length(a, b) == slow_lcs(a, b)


@pytest.mark.parametrize("top", [1, 3])
def test_in_task_matches_equal_brute_force(top):
    probes, names = data(5)
    found = lcs.best_matches(probes, names, list(range(len(names))), 0.7, top)
    assert sorted(zip(found.name, found.match, found.score.round(9))) == brute(probes, names, top)


@pytest.mark.parametrize("letters", [0, 5])
def test_similar_names_equal_brute_force(spark, monkeypatch, letters):
    """With tiny blocks and salts, so that routing, chunks and salting all take part."""
    monkeypatch.setattr(match, "BLOCK_NAMES", 4)
    monkeypatch.setattr(match, "TASK_PROBES", 5)
    if letters:
        monkeypatch.setattr(match, "SIGNATURE", "aeroilntscdm"[:letters])
    probes, names = data(7)
    p = spark.createDataFrame([(x,) for x in probes], "name string")
    n = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, position long")
    found = [(r.name, r.match, round(r.score, 9)) for r in match.similar_names(p, n).collect()]
    assert sorted(found) == brute(probes, names)


CATALOGUE_ROWS = [
    ("Gingerbon Regular 125g", "Snacks", "Candy", " 0012 ", "S1", 0),
    ("GINGERBON regular 125g", "Sweets", "Candy2", "0012", "S2", 1),
    ("Salonpas Plaster (methyl salicylate)  20s", "Rx", "Pain", "77", "S3", 2),
    ("Tea", None, "Drinks", "0012", "S4", 3),
    ("Tea", None, "Late", "99", "S5", 4),
    ("Coffee 3in1", "Bar", None, "99", "S6", 5),
]


@pytest.fixture
def catalogue(spark):
    return spark.createDataFrame(CATALOGUE_ROWS, CATALOGUE)


def test_last_row_wins(catalogue):
    codes = {r.barcode: (r.category, r.tab) for r in match.barcode_lookup(catalogue).collect()}
    assert codes == {"0012": ("Drinks", "Sweets"), "77": ("Pain", "Rx"), "99": ("Late", "Bar")}
    names = {r.name: (r.category, r.tab, r.position) for r in match.name_lookup(catalogue).collect()}
    assert names == {"gingerbon regular 125g": ("Candy2", "Sweets", 0), "salonpas plaster 20s": ("Pain", "Rx", 2)}


def test_barcode_then_name_then_similar(spark, catalogue):
    keys = spark.createDataFrame([
        ("0012", "anything"), (None, "gingerbon regular 125g"), ("x", "salonpas plastr 20"), ("y", "zzz"), (None, ""), (" 77", None),
    ], "item_code string, name string")
    got = {(r.item_code, r.name): (r.category, r.tab, r.method) for r in match.match_products(keys, catalogue).collect()}
    assert got == {
        ("0012", "anything"): ("Drinks", "Sweets", "barcode"),
        (None, "gingerbon regular 125g"): ("Candy2", "Sweets", "name"),
        ("x", "salonpas plastr 20"): ("Pain", "Rx", "fuzzy"),
        ("y", "zzz"): (None, None, "none"),
        (None, ""): (None, None, "none"),
        (" 77", None): ("Pain", "Rx", "barcode"),
    }


def test_lines_get_their_match(spark, catalogue):
    lines = spark.createDataFrame([("f", 0, 0, "0012", "tea"), ("f", 0, 1, None, "salonpas plastr 20"), ("f", 0, 2, None, "")],
                                  "file string, chunk long, row_index long, item_code string, match_name string")
    got = {r.row_index: (r.category, r.tab) for r in match.match_lines(lines, catalogue).collect()}
    assert got == {0: ("Drinks", "Sweets"), 1: ("Pain", "Rx"), 2: (None, None)}


def test_token_candidates(spark):
    p = spark.createDataFrame([("red tea cup",), ("ab",)], "name string")
    n = spark.createDataFrame([("red cup",), ("tea",), ("mug",)], "name string")
    got = sorted(((r.name, r.candidate) for r in match.token_candidates(p, n).collect()), key=str)
    assert got == sorted([("red tea cup", "red cup"), ("red tea cup", "tea"), ("ab", None)], key=str)


def test_expansion(spark, catalogue):
    products = spark.createDataFrame([("A1", "Gingerbon regular 125", None, None), ("A2", "unknown thing", "", None), ("A3", "Tea", "has", None)],
                                     "item_code string, description string, category string, tab string")
    added = product.expand_catalogue(catalogue, products)
    assert [tuple(r) for r in added.collect()] == [("Gingerbon regular 125", "Snacks", "Candy", "A1", "AUTO-A1")]
    assert append_products(catalogue, added).agg(F.max("position")).first()[0] >= 6
    approved = spark.createDataFrame([("A9",)], "item_code string")
    assert product.expand_catalogue(catalogue, products, approved=approved).isEmpty()


def test_update_never_erases(spark):
    products = spark.createDataFrame([("a", "old", None), ("b", None, "t"), ("c", "x", "y")], "item_code string, category string, tab string")
    updates = spark.createDataFrame([("a", None, "new"), ("b", "new", None), ("c", "no", "no")], "item_code string, category string, tab string")
    got = sorted(tuple(r) for r in product.update_categories(products, updates).collect())
    assert got == [("a", "old", "new"), ("b", "new", "t"), ("c", "x", "y")]


def test_seeds_leave_few_pairs_and_lose_none(spark):
    """Three thousand names of three words over one small set of letters, which letter counts hardly tell apart."""
    rnd = random.Random(11)
    syllables = ["ba", "co", "di", "fe", "gu", "ha", "jo", "ki", "lo", "mi", "na", "po", "ra", "se", "ti", "ve"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 4))) for _ in range(1500)]
    names = sorted({" ".join(rnd.choice(words) for _ in range(3)) for _ in range(3000)})
    probes = {"nothing like these at all", "", "x"}
    for name in rnd.sample(names, 120):
        letters = list(name)
        for _ in range(rnd.randint(0, 4)):
            letters[rnd.randrange(len(letters))] = rnd.choice("abcdefgh ")
        probes.add(" ".join("".join(letters).split()))
    probes = sorted(probes)
    p = spark.createDataFrame([(x,) for x in probes], "name string")
    n = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, position long")
    found = [(r.name, r.match, round(r.score, 9)) for r in match.similar_names(p, n).collect()]
    assert sorted(found) == brute(probes, names)
    entries, directory = match.blocks_of(n)
    asked = match.left_lookup(p, match.seed_scores(p, n, match.THRESHOLD, 1), ["name"])
    sizes = entries.groupBy("band", "bits", "block_chunk").agg(F.count(F.lit(1)).alias("n"))
    pairs = match.route(asked, directory, match.THRESHOLD).join(sizes, ["band", "bits", "block_chunk"]).agg(F.sum("n")).first()[0]
    assert pairs <= 0.25 * len(probes) * len(names)
