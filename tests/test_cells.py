"""Derived cells that Spark renders in fewer steps are the same text as those of the shared SQL."""

from pyspark.sql import functions as F

from benchset import rawdata as R
from tillflow.operators.audit import column_profile

CENTS = [None, -123456, -100, -99, -10, -9, -1, 0, 5, 9, 10, 99, 100, 101, 9999, 99999, 100000, 100005, 123456, 99999999, 2**63 - 1]


def test_amounts_as_in_the_shared_sql(spark):
    rows = spark.createDataFrame([(c,) for c in CENTS], "c long")
    pairs = [(R.cents_text, R.spark_cents_text, "."), (R.cents_text, R.spark_cents_text, ",")]
    for plain, quick, point in pairs:
        found = rows.select(F.expr(plain("c", point)).alias("a"), F.expr(quick("c", point)).alias("b")).collect()
        assert [r.b for r in found] == [r.a for r in found]
    for marks in ((",", "."), (".", ",")):
        found = rows.select(F.expr(R.grouped_text("c", *marks)).alias("a"), F.expr(R.spark_grouped_text("c", *marks)).alias("b")).collect()
        assert [r.b for r in found] == [r.a for r in found]


def test_cells_as_in_the_shared_sql(spark, tmp_path):
    lines = [(o, o % 3, o % 4, n, float(q), price, rate, flag, moment) for o, n, q, price, rate, flag, moment in [
        *[(i, i % 7, i % 50, i * 913.37, (i % 11) / 100, "RAN"[i % 3], "1996-02-%02d 00:00:00" % (i % 28 + 1)) for i in range(1, 700)],
        (701, 1, 2, None, 0.1, "R", "1996-02-01 00:00:00"), (702, 1, 2, -0.05, 0.0, "A", None), (703, 1, 2, -0.5, 0.5, None, "1996-02-01 00:00:00"),
        (704, 1, 2, -1234.5, None, "N", "1996-02-01 00:00:00")]]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate string"
    spark.createDataFrame(lines, names).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, "tin can"), (1, None), (2, 'a "b"')], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    shared, quick = (R.run_sql(spark, str(tmp_path), sql) for sql in (R.RAW, R.SPARK_RAW))
    assert quick.dtypes == shared.dtypes and shared.count() > 700
    assert shared.exceptAll(quick).isEmpty() and quick.exceptAll(shared).isEmpty()


def test_profile_leaves_out_null_empty_and_nan(spark):
    rows = spark.createDataFrame([(None, 1), ("", None), ("nan", 2), ("x", 3)], "a string, b int")
    assert {r["column"]: r.non_null for r in column_profile(rows).collect()} == {"a": 1, "b": 3}
