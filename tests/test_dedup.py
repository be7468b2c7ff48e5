import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillflow.operators import dedup, skew
from tillflow.plans import load


@pytest.fixture(params=["broadcast", "shuffled"])
def lookup_path(request, spark):
    """Both ways Spark can join a lookup must give the same rows."""
    if request.param == "shuffled":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def placed(spark, n=4000, seed=1):
    """Lines of two files; one key holds a third of them, some keys are null."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if pick.random() < 0.34 else (None if pick.random() < 0.1 else f"k{pick.randrange(n)}")
        rows.append((f"f{i % 2}", i // 500, i, key, pick.random()))
    return spark.createDataFrame(rows, "file string, chunk long, row_index long, k string, v double").repartition(7)


def test_keep_first(spark, lookup_path):
    rows = placed(spark)
    kept = dedup.keep_first(rows, F.col("k")).collect()
    first = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file, r.chunk, r.row_index)):
        first.setdefault(r.k if r.k is not None else (r.file, r.row_index), r)
    assert sorted((r.file, r.row_index) for r in kept) == sorted((r.file, r.row_index) for r in first.values())


def test_skewed_lookup(spark, lookup_path):
    rows = placed(spark)
    lookup = rows.where("k is not null").groupBy("k").agg(F.max("v").alias("top"))
    found = skew.left_lookup(rows, lookup, ["k"])
    wanted = rows.join(lookup, "k", "left").select(*found.columns)
    assert found.count() == rows.count()
    assert found.exceptAll(wanted).isEmpty()


def test_nulls_equal_each_other(spark):
    from tillflow.functions.keys import group_digest

    rows = spark.createDataFrame([(None, "a"), (None, "a"), ("", "a"), ("a", None), ("1:a", "-")], "x string, y string")
    assert rows.select(group_digest(F.col("x"), F.col("y"))).distinct().count() == 4


def test_fill_down_equals_one_window(spark):
    rows = placed(spark).withColumn("k", F.when(F.col("v") < 0.3, F.col("k")))
    whole = Window.partitionBy("file").orderBy("chunk", "row_index").rowsBetween(Window.unboundedPreceding, 0)
    wanted = rows.withColumn("k", F.last("k", ignorenulls=True).over(whole))
    filled = dedup.fill_down(rows, ["k"])
    assert filled.exceptAll(wanted.select(*filled.columns)).isEmpty()
    assert filled.repartition(3).count() == rows.count()


def test_batch_duplicates(spark, lookup_path):
    rows = placed(spark).where("k is not null").withColumnRenamed("k", "row_hash")
    stored = spark.createDataFrame([("hot",), ("k1",), ("other",)], "row_hash string")
    marked = load.mark_duplicates(rows, stored)
    new = marked.where(~F.col("is_duplicate"))
    wanted = {r.row_hash for r in rows.collect()} - {"hot", "k1"}
    assert marked.count() == rows.count()
    assert sorted(r.row_hash for r in new.collect()) == sorted(wanted)
