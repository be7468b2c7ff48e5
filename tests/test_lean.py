"""Columns that nothing asks for are not stored, and shorter ways to a value give the same one."""

import datetime

import pytest
from pyspark.sql import functions as F

from tillflow.functions import keys
from tillflow.plans import clean
from tillflow.schema import REQUIRED_HEADER
from tillflow.sources.reports import scan_reports

LINES = [",".join(REQUIRED_HEADER), '2023-01-01,R1,S1,1,"tea\nblue",1,,2.00,1.00,1.00,Cash,C1', "2023-01-02,R2,S1,2,milk,1,,3.00,1.00,2.00,Cash,C1"]


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_a_scan_stores_the_columns_it_is_asked_for(spark, tmp_path, mode):
    (tmp_path / "a.csv").write_text("\n".join(LINES) + "\n")
    rows, files = scan_reports(spark, str(tmp_path), mode, columns=["receipt", "description"])
    assert set(rows.columns) == {"file", "chunk", "row_index", "receipt", "description"}
    assert {(r.receipt, r.description) for r in rows.collect()} == {("R1", "tea\nblue"), ("R2", "milk")}
    assert [r.status for r in files.collect()] == ["OK"]


def test_labelled_lines_are_stored_without_what_only_rules_look_at(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([*LINES, LINES[2], ",,,,,,,,,,,"]) + "\n")
    cleaned = clean.clean_reports(spark, str(tmp_path))
    assert {(r.receipt, r.description) for r in cleaned.lines.collect()} == {("R1", "tea blue"), ("R2", "milk")}
    assert sorted(r.error_reason for r in cleaned.rejects.collect()) == ["completely empty row", "duplicate row"]
    stored = cleaned.rejects._jdf.queryExecution().analyzed().toString()
    assert "error_reason" in stored and "literal_amounts" not in stored and "unit_found" not in stored


def test_time_text_is_that_of_the_patterns(spark):
    times = ["0000-01-01 00:00:00", "0001-01-01 00:00:00", "0999-12-31 00:00:00", "1000-01-01 00:00:00", "1582-10-10 00:00:00",
             "2023-01-05 00:00:00", "2023-01-05 00:00:00.5", "2023-01-05 00:00:01", "2023-01-05 14:30:00", "9999-12-31 00:00:00", None]
    rows = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("t"))
    moment = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    wanted = F.when(moment.endswith("T00:00:00"), F.date_format("t", "yyyy-MM-dd")).otherwise(moment)
    for found, want in rows.select(keys._time_text(F.col("t")), wanted).collect():
        assert found == want
    assert rows.where(F.col("t") == datetime.datetime(2023, 1, 5)).select(keys._time_text(F.col("t"))).first()[0] == "2023-01-05"
