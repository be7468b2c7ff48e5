"""Records that span lines and scan splits, against Python's CSV reader."""

import csv
import io
import random

import pytest

from tillflow.plans.clean import clean_reports
from tillflow.schema import REQUIRED_HEADER
from tillflow.sources import records
from tillflow.sources.reports import scan_reports

HEADER = ",".join(REQUIRED_HEADER)


def report(seed, rows):
    """A report whose descriptions hold line breaks, quotes, commas and blank lines."""
    rnd = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for n in range(rows):
        parts = [rnd.choice(["Tea", 'a "b" c', "x,y", "", "line", '"', 'He said ""', "5' pipe"]) for _ in range(rnd.randint(1, 3))]
        text = rnd.choice(["\n", "\n\n", " ", " "]).join(parts) if rnd.random() < 0.5 else f"Item {n}"
        writer.writerow(["2023-01-01", f"R{n}", "S1", n, text, 1, "", 10, 8, 2, "Cash", "C1"])
    return out.getvalue()


@pytest.mark.parametrize("mode,split", [("strict", "128m"), ("strict", "400"), ("lenient", "400")])
def test_records_against_a_csv_reader(spark, tmp_path, mode, split):
    rows = 150
    bodies = {f"f{n}.csv": report(n, rows) for n in range(3)} | {"plain.csv": "".join(
        f"2023-01-01,P{n},S1,{n},5\" pipe,1,,10,8,2,Cash,C1\n" for n in range(20))}
    for name, body in bodies.items():
        # The title has a quote that is never closed; the header starts the reader anew.
        (tmp_path / name).write_text(f'"Sales, all\n\n{HEADER}\n{body}' if mode == "strict" else f"{HEADER}\n{body}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found, files = scan_reports(spark, str(tmp_path), mode)
        got = sorted((r.receipt, r.item_code, r.description or "", r.cashier_id) for r in found.collect())
        assert {r.status for r in files.collect()} == {"OK"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    want = []
    for body in bodies.values():
        want += [(r[1], r[3], r[4], r[11]) for r in csv.reader(io.StringIO(body, newline=""))]
    assert got == sorted(want)


def test_no_shifted_cells(spark, tmp_path):
    lines = ["2023-01-01,R1,S1,7,\"Milk", "10, 2 liters\",1,,10,8,2,Cash,C1", "2023-01-02,R2,S1,8,Tea,1,,5,4,1,Cash,C1"]
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    cleaned = clean_reports(spark, str(tmp_path))
    assert sorted((r.receipt, r.item_code, r.description, r.qty, r.sales) for r in cleaned.lines.collect()) == [
        ("R1", "7", "Milk 10, 2 liters", 1.0, 10.0), ("R2", "8", "Tea", 1.0, 5.0)]
    assert cleaned.rejects.count() == 0


def test_a_quote_that_is_never_closed_stops_its_file_only(spark, tmp_path, monkeypatch):
    good = "2023-01-01,R1,S1,7,Tea,1,,10,8,2,Cash,C1\n"
    (tmp_path / "good.csv").write_text(f"{HEADER}\n{good}")
    (tmp_path / "open.csv").write_text(f'{HEADER}\n{good}2023-01-01,R2,S1,7,"Tea,1,,10,8,2,Cash,C1\n{good}')
    (tmp_path / "long.csv").write_text(f'{HEADER}\n2023-01-01,R3,S1,7,"Tea\n' + "x\n" * 30 + 'end",1,,10,8,2,Cash,C1\n')
    monkeypatch.setattr(records, "RECORD_LINES", 20)
    cleaned = clean_reports(spark, str(tmp_path))
    status = {r.file.rsplit("/", 1)[1]: r.status for r in cleaned.files.collect()}
    assert status == {"good.csv": "OK", "open.csv": "UNCLOSED_QUOTE", "long.csv": "UNCLOSED_QUOTE"}
    assert [r.receipt for r in cleaned.lines.collect()] == ["R1"]
