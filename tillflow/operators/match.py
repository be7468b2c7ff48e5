"""Matching sales lines to the product catalogue: barcode, name, then similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.functions.lcs import block_matcher, pair_score
from tillflow.functions.text import blank_to_null, improved_name, normalise_barcode
from tillflow.operators.skew import left_lookup
from tillflow.session import materialise

THRESHOLD = 0.7

# Names of a block have lengths in one band and agree on which signature letters they use.
BAND_RATIO = 1.1
SIGNATURE = "aeroilnst"
# Seeds: candidates that share a piece of a name with at most so many names, how many of them are scored for a probe,
# and the lengths of the pieces: short ones are rare in small catalogues, long ones also in large ones.
RARE, SEEDS, GRAMS = 48, 12, (4, 6, 8)
BLOCK_NAMES = 4096
TASK_PROBES = 20_000


def _last(value: str, of: Column) -> Column:
    return F.max(F.when(of, F.struct("position", F.col(value).alias("v"))))["v"]


def barcode_lookup(catalogue: DataFrame) -> DataFrame:
    """Per barcode its last category and its last tab, each on its own."""
    return (
        catalogue.withColumn("barcode", normalise_barcode(F.col("barcode")))
        .where(F.col("barcode").isNotNull())
        .groupBy("barcode")
        .agg(
            blank_to_null(_last("category", F.col("category").isNotNull())).alias("category"),
            blank_to_null(_last("tab", F.col("tab").isNotNull())).alias("tab"),
        )
    )


def name_lookup(catalogue: DataFrame) -> DataFrame:
    """Per normalised name the last row that has both category and tab; placed at its first row."""
    both = F.col("category").isNotNull() & F.col("tab").isNotNull()
    return (
        catalogue.where(both)
        .withColumn("name", improved_name(F.col("product_name")))
        .where(F.col("name") != "")
        .groupBy("name")
        .agg(
            blank_to_null(F.max(F.struct("position", "category"))["category"]).alias("category"),
            blank_to_null(F.max(F.struct("position", "tab"))["tab"]).alias("tab"),
            F.min("position").alias("position"),
        )
    )


def match_barcodes(keys: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add ``barcode_category`` and ``barcode_tab`` by item code."""
    lookup = materialise(barcode_lookup(catalogue), "barcodes").withColumnsRenamed(
        {"category": "barcode_category", "tab": "barcode_tab"}
    )
    coded = keys.withColumn("barcode", normalise_barcode(F.col("item_code")))
    return left_lookup(coded, lookup, ["barcode"]).drop("barcode")


def match_names(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``name_category`` and ``name_tab`` from a :func:`name_lookup`."""
    lookup = names.drop("position").withColumnsRenamed({"category": "name_category", "tab": "name_tab"})
    return left_lookup(keys, lookup, ["name"])


def _band(length: Column) -> Column:
    return F.floor(F.log(length) / F.lit(math.log(BAND_RATIO))).cast("int")


def _letter_count(name: Column, letter: str) -> Column:
    return F.length(name) - F.length(F.translate(name, letter, ""))


def _grams(name: Column) -> Column:
    """The distinct pieces of ``GRAMS`` letters; a shorter name is a piece itself."""
    def pieces(q: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(name) - (q - 1), F.lit(1)))
        return F.transform(places, lambda i: F.substring(name, i, F.lit(q)))

    return F.array_distinct(F.concat(*[pieces(q) for q in GRAMS]))


def seed_scores(probes: DataFrame, names: DataFrame, threshold: float, top: int) -> DataFrame:
    """(name, seed) for probes of which ``top`` names above ``threshold`` are found by rare pieces.

    The seed is the score that the probe's ``top``-th best name reaches at least. It only spares work: a probe
    without one is compared with all that the threshold allows.
    """
    postings = names.select(F.col("name").alias("match"), F.explode(_grams(F.col("name"))).alias("gram"))
    rare = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= RARE).select("gram")
    wanted = probes.select("name", F.explode(_grams(F.col("name"))).alias("gram"))
    shared = wanted.join(rare, "gram").join(postings, "gram").groupBy("name", "match").agg(F.count(F.lit(1)).alias("shared"))
    likely = Window.partitionBy("name").orderBy(F.desc("shared"), "match")
    pairs = shared.withColumn("_nth", F.row_number().over(likely)).where(F.col("_nth") <= max(SEEDS, 2 * top))
    # A probe has a bounded number of pairs here.
    scored = pairs.select("name", pair_score(F.col("name"), F.col("match")).alias("score")).where(F.col("score") > threshold)
    best = F.sort_array(F.collect_list("score"), asc=False)
    return scored.groupBy("name").agg(F.get(best, F.lit(top - 1)).alias("seed")).where(F.col("seed").isNotNull())


def route(probes: DataFrame, directory: DataFrame, threshold: float) -> DataFrame:
    """(name, least, block): the blocks that can hold a name as similar as the probe's ``least`` score."""
    m, least = F.length("name"), F.col("least")
    ratio = least / (2 - least)
    shortest = F.greatest(F.lit(1), F.floor(m * ratio - 1e-9).cast("int"))
    longest = F.ceil(m / ratio + 1e-9).cast("int")
    counts = {f"_p{i}": _letter_count(F.col("name"), letter) for i, letter in enumerate(SIGNATURE)}
    placed = probes.withColumn("least", F.coalesce("seed", F.lit(threshold))).where(F.col("name") != "").select(
        "name", "least", m.alias("m"), *[c.alias(n) for n, c in counts.items()],
        F.explode(F.sequence(_band(shortest), _band(longest))).alias("band"))
    lost, unmet = F.lit(0), F.lit(0)
    for i in range(len(SIGNATURE)):
        lost = lost + F.greatest(F.col(f"_p{i}") - F.col(f"_hi{i}"), F.lit(0))
        unmet = unmet + F.greatest(F.col(f"_lo{i}") - F.col(f"_p{i}"), F.lit(0))
    # Upper bounds of the score with any name of the block, by letters the block lacks and by letters it needs.
    by_probe = 2 * (F.col("m") - lost) + 1e-9 >= least * (F.col("m") + F.greatest(F.col("min_n"), F.col("m") - lost))
    by_block = 2 * (F.col("max_n") - unmet) + 1e-9 >= least * (F.col("m") + F.col("max_n"))
    return placed.join(F.broadcast(directory), "band").where(by_probe & by_block).select(
        "name", "least", "band", "bits", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("block_chunk"))


def similar_names(probes: DataFrame, names: DataFrame, threshold: float = THRESHOLD, top: int = 1) -> DataFrame:
    """For each probe ``name`` the ``top`` entries of ``names`` (name, position) above ``threshold``.

    The score is 2 * LCS / (m + n). Rare pieces find most probes a good name at once; its score is the probe's
    seed, and only blocks of the catalogue that can hold a name as good are visited. Blocks are cut by length band
    and by the signature letters their names use; the most and fewest of each such letter bound the score of a
    whole block, and the bounds never lose a pair. Blocks are limited in names and salted by their number of
    probes, so no task gets more than a slice of either; inside a task only the best ``top`` per probe leave.
    """
    none_found = "name string, match string, position long, score double" + ("" if top == 1 else ", rank int")
    if probes.isEmpty():
        return probes.sparkSession.createDataFrame([], none_found)
    entries, directory = blocks_of(names)
    asked = left_lookup(probes.select("name"), materialise(seed_scores(probes, names, threshold, top), "seeds"), ["name"])
    routed = route(asked, directory, threshold)
    block = ["band", "bits", "block_chunk"]
    salts = routed.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / TASK_PROBES).cast("int").alias("salts"))
    salted_probes = routed.join(salts, block).withColumn("salt", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int"))
    salted_names = entries.join(salts, block).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    group = [*block, "salt"]
    theirs = [f"entry_{g}" for g in group]
    entry_groups = salted_names.select("name", "position", *[F.col(g).alias(t) for g, t in zip(group, theirs)])
    found = (
        salted_probes.select("name", "least", *group).groupBy(*group)
        .cogroup(entry_groups.groupBy(*theirs))
        .applyInPandas(block_matcher(threshold, top), "name string, match string, position long, score double")
    )
    return _best(found, top)


def blocks_of(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names with their block, one row per block: bounded by bands * 2 ** letters)."""
    placed = names.where(F.col("name") != "").select(
        "name", "position", F.length("name").alias("n"), _band(F.length("name")).alias("band"),
        _bits(F.col("name"), SIGNATURE).alias("bits"),
        *[_letter_count(F.col("name"), letter).alias(f"_c{i}") for i, letter in enumerate(SIGNATURE)])
    bounds = [f(F.col(f"_c{i}")).alias(f"{label}{i}") for i in range(len(SIGNATURE)) for f, label in ((F.max, "_hi"), (F.min, "_lo"))]
    directory = placed.groupBy("band", "bits").agg(
        F.min("n").alias("min_n"), F.max("n").alias("max_n"),
        F.ceil(F.count(F.lit(1)) / BLOCK_NAMES).cast("int").alias("chunks"), *bounds)
    entries = placed.join(F.broadcast(directory.select("band", "bits", "chunks")), ["band", "bits"]).withColumn(
        "block_chunk", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")).drop(
            "n", *[f"_c{i}" for i in range(len(SIGNATURE))])
    return entries, directory


def _bits(name: Column, letters: str) -> Column:
    bits = F.lit(0)
    for i, letter in enumerate(letters):
        bits = bits + F.when(name.contains(letter), F.lit(1 << i)).otherwise(0)
    return bits


def _best(found: DataFrame, top: int) -> DataFrame:
    if top == 1:
        best = F.max(F.struct("score", (-F.col("position")).alias("neg"), "match")).alias("b")
        return found.groupBy("name").agg(best).select(
            "name", F.col("b.match").alias("match"), (-F.col("b.neg")).alias("position"), F.col("b.score").alias("score")
        )
    ranked = Window.partitionBy("name").orderBy(F.desc("score"), "position")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)


def match_products(keys: DataFrame, catalogue: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add category, tab and match method to a stored table of distinct (item_code, name) pairs.

    The barcode decides; what it leaves open the exact name fills, then the most similar name.
    Only names still open reach the similarity step, each once.
    """
    entries = materialise(name_lookup(catalogue), "names")
    exact = match_names(match_barcodes(keys, catalogue), entries)
    category = F.coalesce("barcode_category", "name_category")
    tab = F.coalesce("barcode_tab", "name_tab")
    no_name_hit = F.col("name_category").isNull() & F.col("name_tab").isNull()
    open_name = F.when((category.isNull() | tab.isNull()) & no_name_hit & (F.col("name") != ""), F.col("name"))
    opened = materialise(exact.withColumn("open_name", open_name), "opened")
    names = opened.where(F.col("open_name").isNotNull()).select(F.col("open_name").alias("name")).distinct()
    names = materialise(names, "open-names")
    similar = materialise(similar_names(names, entries.select("name", "position"), threshold), "similar")
    values = entries.select(F.col("name").alias("match"), F.col("category").alias("similar_category"),
                            F.col("tab").alias("similar_tab"))
    lookup = materialise(left_lookup(
        similar.select(F.col("name").alias("open_name"), "match", "score"), values, ["match"]
    ).select("open_name", "similar_category", "similar_tab", "score"), "similar-values")
    joined = left_lookup(opened, lookup, ["open_name"])
    method = (
        F.when(F.col("barcode_category").isNotNull() | F.col("barcode_tab").isNotNull(), "barcode")
        .when(~no_name_hit, "name")
        .when(F.col("score").isNotNull(), "fuzzy")
        .otherwise("none")
    )
    return joined.select(
        *keys.columns,
        F.coalesce("barcode_category", "name_category", "similar_category").alias("category"),
        F.coalesce("barcode_tab", "name_tab", "similar_tab").alias("tab"),
        method.alias("method"),
    )


def match_lines(lines: DataFrame, catalogue: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Attach category and tab to lines with ``item_code`` and ``match_name``.

    Each distinct pair is matched once, however many lines carry it.
    """
    code, name = F.coalesce("item_code", F.lit("")), F.coalesce("match_name", F.lit(""))
    pairs = lines.groupBy(code.alias("item_code"), name.alias("name")).agg(F.count(F.lit(1)).alias("lines"))
    matched = materialise(match_products(materialise(pairs, "pairs"), catalogue, threshold), "matches")
    packed = matched.select(
        F.col("item_code").alias("_code"), F.col("name").alias("_name"), F.struct("category", "tab").alias("_match")
    )
    sided = lines.withColumns({"_code": code, "_name": name})
    out = left_lookup(sided, packed, ["_code", "_name"])
    return out.select(*lines.columns, F.col("_match.category").alias("category"), F.col("_match.tab").alias("tab"))


def match_statistics(matched: DataFrame, catalogue_names: DataFrame) -> DataFrame:
    """Distinct names looked up and lines covered per match method, with the catalogue size."""
    size = catalogue_names.agg(F.countDistinct("name").alias("catalogue_names"))
    return matched.groupBy("method").agg(
        F.countDistinct("name").alias("names"),
        F.sum("lines").alias("lines"),
    ).withColumn("catalogue_names", size.scalar()).withColumn(
        "coverage", F.round(F.try_divide(F.col("names").cast("double"), F.col("catalogue_names").cast("double")), 4)
    )


def word_index(names: DataFrame) -> DataFrame:
    """(word, name) for every distinct word of three letters or more."""
    words = F.array_distinct(F.filter(F.split("name", " "), lambda w: F.length(w) >= 3))
    return names.select("name", words.alias("words")).select("name", "words", F.explode("words").alias("word"))


def token_candidates(probes: DataFrame, names: DataFrame) -> DataFrame:
    """Names sharing a word with a probe; a null candidate stands for the whole catalogue.

    A pair is produced only at the first of its shared words, so no distinct is needed.
    """
    left = word_index(probes)
    right = word_index(names).select("word", F.col("name").alias("candidate"), F.col("words").alias("other_words"))
    first_shared = F.array_min(F.array_intersect("words", "other_words"))
    pairs = left.join(right, "word").where(F.col("word") == first_shared).select("name", "candidate")
    matched = left.join(right.select("word").distinct(), "word", "left_semi").select("name").distinct()
    alone = probes.select("name").distinct().join(matched, "name", "left_anti")
    return pairs.unionByName(alone.withColumn("candidate", F.lit(None).cast("string")))


def similar_products(probes: DataFrame, catalogue: DataFrame, threshold: float = THRESHOLD, top: int = 5) -> DataFrame:
    """The ``top`` catalogue rows most similar to each probe name."""
    named = catalogue.withColumn("match", improved_name(F.col("product_name")))
    entries = named.where(F.col("match") != "").groupBy(F.col("match").alias("name")).agg(F.min("position").alias("position"))
    best = similar_names(probes, materialise(entries, "entries"), threshold, top).select("name", "match", "score")
    # Of one name no more than ``top`` rows can make the list; the limit is applied before the shuffle.
    nth = Window.partitionBy("match").orderBy("position")
    first_rows = named.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= top).drop("_nth")
    ranked = Window.partitionBy("name").orderBy(F.desc("score"), "position")
    return (
        best.join(first_rows.select("match", "product_name", "position", "category", "tab"), "match")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)
        .select("name", "rank", "product_name", "score", "category", "tab", "position")
    )
