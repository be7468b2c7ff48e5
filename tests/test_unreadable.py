"""Files that cannot be read, or are no text, beside files that can."""

import gzip
import random
from urllib.parse import unquote

import pytest

from tillflow.plans.clean import clean_reports
from tillflow.plans.load import unread_files
from tillflow.schema import REQUIRED_HEADER
from tillflow.sources.reports import NoReadableReport, scan_reports

HEADER = ",".join(REQUIRED_HEADER)


def report(rows, receipt="R"):
    rnd = random.Random(rows)
    return HEADER + "\n" + "".join(
        f"2023-01-01,{receipt}{n},S1,{n},Item {rnd.random()},1,0,10,8,2,Cash,C1\n" for n in range(rows))


def damaged(folder):
    (folder / "good.csv").write_text(report(20))
    (folder / "whole.csv.gz").write_bytes(gzip.compress(report(30, "Z").encode()))
    (folder / "cut.csv.gz").write_bytes(gzip.compress(report(30_000).encode())[:200_000])
    (folder / "a mislabelled%20one.csv.gz").write_text(report(20))
    (folder / "binary.csv").write_bytes(bytes(range(256)) * 40)
    (folder / "wide.csv").write_bytes(report(20).encode("utf-16"))


@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_unreadable_files_do_not_stop_the_others(spark, tmp_path, mode):
    damaged(tmp_path)
    rows, files = scan_reports(spark, str(tmp_path), mode)
    status = {unquote(r.file.rsplit("/", 1)[1]): (r.status, r.lines > 0) for r in files.collect()}
    assert status.pop("binary.csv")[0] == "NOT_TEXT" and status.pop("wide.csv")[0] == "NOT_TEXT"
    assert status == {"good.csv": ("OK", True), "whole.csv.gz": ("OK", True), "cut.csv.gz": ("UNREADABLE", False),
                      "a mislabelled%20one.csv.gz": ("UNREADABLE", False)}
    # Nothing of a cut archive is kept, though its first lines could be read.
    found = {unquote(r["file"].rsplit("/", 1)[1]): r["count"] for r in rows.groupBy("file").count().collect()}
    assert found == {"good.csv": 20, "whole.csv.gz": 30}


def test_unreadable_files_are_logged(spark, tmp_path):
    damaged(tmp_path)
    cleaned = clean_reports(spark, str(tmp_path))
    assert cleaned.lines.count() == 50
    logged = sorted((r.error_reason, unquote(r.file.rsplit("/", 1)[1])) for r in unread_files(cleaned.files).collect())
    assert logged == [("NOT_TEXT", "binary.csv"), ("NOT_TEXT", "wide.csv"),
                      ("UNREADABLE", "a mislabelled%20one.csv.gz"), ("UNREADABLE", "cut.csv.gz")]


def test_only_unreadable_files(spark, tmp_path):
    (tmp_path / "cut.csv.gz").write_text("no archive")
    with pytest.raises(NoReadableReport):
        clean_reports(spark, str(tmp_path))


def test_zero_byte_below_a_header_is_text(spark, tmp_path):
    (tmp_path / "r.csv").write_text(report(3).replace(",Cash,", ",Ca\0sh,"))
    assert [r.status for r in scan_reports(spark, str(tmp_path))[1].collect()] == ["OK"]
