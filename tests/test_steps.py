"""Steps of a run that are taken once, and what they leave on disk."""

import datetime

from pyspark.sql import functions as F

from tillflow.functions import text
from tillflow.operators import rules
from tillflow.plans import clean
from tillflow.schema import STAGING
from tillflow.sources.tables import AppendTable, files_matching


def test_cells_are_stripped_alike_on_both_ways(column):
    marks = [*text.WHITESPACE, "\x7f", "\x80", "\u200b", "!", "é", "x", "\U0001f600"]
    values = [None, "", *marks, *[f"{a}x y{b}" for a in marks for b in marks]]
    assert column(text.strip_cell, values) == column(text.strip, values)
    assert column(text.has_text, values) == column(lambda c: text.strip(c) != "", values)


def test_rules_are_asked_once_for_keys_and_lines(spark):
    """The labelled lines are stored with their keys, so what follows holds no rule any more."""
    line = "f string, file string, chunk long, row_index long"
    rows = spark.createDataFrame([("x", "a", 0, 1), ("x", "a", 0, 2), ("y", "a", 0, 3)], line)
    day = F.lit(datetime.datetime(2023, 1, 1))
    values = rows.select(
        "file", "chunk", "row_index", day.alias("date"), F.col("f").alias("receipt"), F.lit("s").alias("so"), F.lit("1").alias("item_code"),
        F.lit("tea").alias("description"), *[F.lit(1.0).alias(c) for c in ("qty", "sales", "cost", "profit")],
        F.lit(None).cast("string").alias("summary"), F.lit(False).alias("row_is_empty"), F.lit(False).alias("gate_fired"))
    missing = [c for c in rules.IMPORTANT_COLUMNS if c not in values.columns]
    values = values.withColumns({c: F.lit(None).cast("string") for c in missing})
    per_file = spark.createDataFrame([("a", 0)], "file string, bare_lines long")
    labelled = clean.label_lines(values, per_file)
    assert {r.row_index: r.error_reason for r in labelled.collect()} == {1: None, 2: "duplicate row", 3: None}
    assert "RLIKE" not in labelled._jdf.queryExecution().optimizedPlan().toString()


def test_a_partition_has_files_by_its_rows_not_by_the_tasks(spark, tmp_path):
    table = AppendTable(spark, str(tmp_path / "staged"), STAGING, ["run_id", "month"], {"month": F.date_format("date", "yyyy-MM")})
    days = spark.range(0, 240, 1, 8).select(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("date"),
                                            F.col("id").cast("string").alias("row_hash"), F.lit("r").alias("run_id"))
    rows = days.select(*[(F.col(f.name) if f.name in days.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STAGING.fields])
    table.write(rows)
    assert sorted(r.row_hash for r in table.read().collect()) == sorted(str(i) for i in range(240))
    assert len(files_matching(spark, f"{tmp_path}/staged/run_id=*/month=*/*.parquet")) == 3
