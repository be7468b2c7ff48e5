"""Products meet a catalogue once per version of it; the dimension is merged with one join."""

import datetime

from pyspark.sql import functions as F

from tillflow.operators import product
from tillflow.plans.load import refresh_products
from tillflow.schema import CATALOGUE, DIM_PRODUCT
from tillflow.sources.catalogue import catalogue_version
from tillflow.sources.tables import Warehouse, read_csv, save_csv

DAY = datetime.date(2023, 1, 1)


def dimension(spark, *named):
    rows = [(n, code, name, None, None, None, DAY, DAY) for n, (code, name) in enumerate(named, 1)]
    return spark.createDataFrame(rows, DIM_PRODUCT)


def entries(spark, *rows):
    return spark.createDataFrame([(*r, f"S{n}", n) for n, r in enumerate(rows)], CATALOGUE)


def test_only_unsettled_products_are_looked_up(spark):
    catalogue = entries(spark, ("Green tea", "Hot", "Tea", "1"), ("Cola can", "Cold", "Soda", "2"))
    first = dimension(spark, ("1", "x"), ("8", "Cola can"), ("9", "Nothing like it"), ("10", None))
    nothing = spark.createDataFrame([], "item_code string, name string, category string, tab string, method string")
    filled, found = product.fill_settled(first, catalogue, nothing)
    assert found.count() == 4
    got = {r.item_code: (r.category, r.tab) for r in filled.collect()}
    assert got == {"1": ("Tea", "Hot"), "8": ("Soda", "Cold"), "9": (None, None), "10": (None, None)}

    # A renamed product and a new one are asked for; the rest take what is settled, also that nothing matched.
    second = dimension(spark, ("1", "x"), ("8", "Green tea"), ("9", "Nothing like it"), ("10", None), ("11", "Cola can"))
    again, now = product.fill_settled(second, catalogue, found)
    assert sorted(r.item_code for r in now.collect()) == ["11", "8"]
    assert sorted(again.collect()) == sorted(product.fill_categories(second, catalogue).collect())
    # Where all is settled the catalogue is not read.
    full, none = product.fill_settled(second, None, found.unionByName(now))
    assert none.isEmpty() and sorted(full.collect()) == sorted(again.collect())


def test_versions_follow_content(spark):
    one = entries(spark, ("Green tea", "Hot", None, "1"), ("Cola can", "Cold", "Soda", "2"))
    assert catalogue_version(one) == catalogue_version(one.repartition(3, "barcode"))
    others = [one.limit(0), one.where("position = 0"), one.withColumn("position", 1 - F.col("position")),
              one.withColumn("category", F.coalesce("category", F.lit("")))]
    assert len({catalogue_version(c) for c in [one, *others]}) == 5


def test_runs_settle_each_name_once_per_version(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))

    def load(run_id, catalogue, *items):
        rows = [(code, name, "pcs", None, None, DAY) for code, name in items]
        lines = spark.createDataFrame(rows, "item_code string, description string, unit string, category string, tab string, date date")
        house.staged = lambda _: lines
        refresh_products(house, run_id, catalogue, 0.7)

    catalogue = entries(spark, ("Green tea", "Hot", "Tea", "77"))
    load("a", catalogue, ("5", "unknown thing"), ("77", "x"))
    load("b", catalogue, ("5", "unknown thing"), ("7", "a third"))
    assert sorted((r.run_id, r.item_code) for r in house.settled.read().collect()) == [("a", "5"), ("a", "77"), ("b", "7")]
    grown = entries(spark, ("Green tea", "Hot", "Tea", "77"), ("Named", "T", "C", "5"))
    load("c", grown, ("7", "a third"))
    assert {r.item_code: r.category for r in house.products.read().collect()} == {"5": "C", "7": None, "77": "Tea"}


def test_merge_keeps_keys_and_numbers_new_products(spark):
    rollup = product.product_rollup(spark.createDataFrame(
        [("2", "new", "pcs", "c", "", DAY), ("3", None, None, None, None, DAY), (None, "x", None, None, None, DAY)],
        "item_code string, description string, unit string, category string, tab string, date date"))
    merged = product.merge_products(dimension(spark, ("1", "a"), ("2", "b")), rollup)
    got = sorted((r.item_code, r.product_key, r.description, r.category, r.tab) for r in merged.collect())
    assert got == [("1", 1, "a", None, None), ("2", 2, "new", "c", None), ("3", 3, None, None, None)]
    fresh = product.merge_products(dimension(spark).limit(0), rollup)
    assert sorted(r.product_key for r in fresh.collect()) == [1, 2]


def test_csv_keeps_quotes_breaks_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, "line\nbreak"), (3, None), (4, "back\\slash")], "n int, t string")
    save_csv(rows, str(tmp_path / "out"))
    assert sorted(read_csv(spark, str(tmp_path / "out"), rows.schema).collect()) == sorted(rows.collect())
