import json

import pytest
from pyspark.sql import functions as F

from tillflow.operators import product, rules
from tillflow.plans import clean, load
from tillflow.schema import CATALOGUE, REQUIRED_HEADER
from tillflow.sources import catalogue as cat
from tillflow.sources import tables
from tillflow.sources.reports import NoReadableReport, line_cells, scan_reports
from tillflow.streaming.ingest import ingest_reports

HEADER = ",".join(REQUIRED_HEADER)
LINES = [
    "2023-01-01,R001,S1,00123,Coca-Cola 195ml,1,,10,8,2,Cash,C1",
    "2023-01-01,R001,S1,00124,Tea #EXP2024-11-01,2,1.00,\"1,234.56\",8,,Card,C1",
    "2023-01-01,R001,S1,00124,Tea #EXP2024-11-01,2,1.00,\"1,234.56\",8,,Card,C1",
    ",,,,Grand Total,,,99,,,,",
    ",,,,,,,,,,,",
    "2023-01-02,R002,,,Tea,1,,10,8,2,Cash,C1",
    "2023-01-02,R002,,Account : 12,,0,0,0,0,0,,",
    "2023-01-02,R002,,999,Senior discount,1,,0,0,0,,",
    "1/3/2023,,,125,Coffee,-1,,5,4,1,Cash,C2",
    "13/45/2023,R003,S2,126,Milk,abc,,x,4,,Cash,C2",
    "2023-01-04,R004,S2,127,,,,,,,Cash,C2",
]
REASONS = {
    "summary/total row matched 'grand total'": 1,
    "completely empty row": 1,
    "financial data present but missing supporting fields": 1,
    'placeholder/non-item row (e.g., header like "Account : ...")': 2,
    "non-item adjustment (e.g., Sales Discount/VOID/rounding)": 1,
    "duplicate row": 1,
}


def write(folder, name, lines, preamble=("Inventory Sales Detail Report", "", "a,b"), header=HEADER):
    (folder / name).write_text("\n".join([*preamble, *([header] if header else []), *lines]) + "\n")


@pytest.fixture
def reports(tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    write(folder, "may.csv", LINES)
    write(folder, "bad.csv", ["1,2,3"], header=None)
    return folder


@pytest.fixture
def catalogue(spark):
    rows = [("Coca-Cola 195ml", "Drinks", "Soda", "00123", "S", 0), ("Tea", "Hot", "Drinks", None, "S", 1)]
    return spark.createDataFrame(rows, CATALOGUE)


def test_cleaning(spark, reports):
    cleaned = clean.clean_reports(spark, str(reports))
    assert {r.error_reason: r["count"] for r in cleaned.rejects.groupBy("error_reason").count().collect()} == REASONS
    lines = {r.item_code: r for r in cleaned.lines.collect()}
    assert sorted(lines) == ["00123", "00124", "125", "126"]
    assert lines["00123"].unit == "ml" and lines["00123"].qty == 1.0
    assert lines["00124"].sales == 1234.56 and str(lines["00124"].expiration_date) == "2024-11-01"
    assert lines["00124"].description == "Tea" and round(lines["00124"].profit, 2) == 1226.56
    assert (lines["125"].receipt, lines["125"].so, lines["125"].txn_type) == ("R001", "S1", "RETURN")
    assert lines["126"].date is None and lines["126"].qty is None and lines["126"].unit is None
    files = {r.file.rsplit("/", 1)[1]: r.status for r in cleaned.files.collect()}
    assert files == {"may.csv": "OK", "bad.csv": "HEADER_NOT_FOUND"}
    assert cleaned.lines.count() + cleaned.rejects.count() == len(LINES)
    kept_text = cleaned.rejects.where(F.col("error_reason") == "duplicate row").first()
    assert kept_text.sales == "1234.56"


def test_result_does_not_depend_on_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    body = [f"2023-01-{1 + i % 28:02d},{'' if i % 3 else f'R{i}'},S{i % 5},{i % 40},Item {i % 40},1,,{i % 9},{i % 7},,Cash,C1" for i in range(3000)]
    for n in range(2):
        write(folder, f"f{n}.csv", body)
    seen = []
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        cleaned = clean.clean_reports(spark, str(folder))
        seen.append(sorted((r.file, r.item_code, r.receipt, r.row_hash) for r in cleaned.lines.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert seen[0] == seen[1] and len(seen[0]) > 100


def test_no_good_file(spark, tmp_path):
    write(tmp_path, "bad.csv", ["1,2"], header=None)
    with pytest.raises(NoReadableReport):
        clean.clean_reports(spark, str(tmp_path))


def test_lenient_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Some title\nPosting Date,Doc No,Product Name,qty sold,Line Amount,UOM\n2023-01-01,R1,"Tea, green",2,"1,5",g\n')
    (tmp_path / "b.csv").write_text("Item,Sales,Date,Receipt\nX1,3,2023-01-02,R9\n")
    rows, _ = scan_reports(spark, str(tmp_path), mode="lenient")
    got = {r.receipt: r for r in rows.collect()}
    assert (got["R1"].item_code, got["R1"].sales, got["R1"].unit) == ("Tea, green", "1,5", "g")
    assert (got["R9"].item_code, got["R9"].date, got["R9"].unit) == ("X1", "2023-01-02", None)
    lines = clean.clean_reports(spark, str(tmp_path), mode="lenient")
    labelled = lines.rejects.where("receipt = 'R1'").first()
    assert labelled.unit == "kg" and labelled.error_reason == "financial data present but missing supporting fields"


def test_line_cells(spark):
    rows = spark.createDataFrame([('a,"b,c",,"d""e"',), (",x",), ("",)], "v string")
    assert [r[0] for r in rows.select(line_cells(F.col("v"))).collect()] == [["a", "b,c", "", 'd"e'], ["", "x"], [""]]


def test_loading_twice_adds_nothing(spark, reports, catalogue, tmp_path):
    root = str(tmp_path / "wh")
    run = load.run_reports(spark, str(reports), catalogue, root)
    house = tables.Warehouse(spark, root)
    facts = sorted((r.receipt_number, r.txn_type, r.unit_price) for r in house.facts.read().collect())
    assert facts == [("R001", "RETURN", -5.0), ("R001", "SALE", 10.0), ("R001", "SALE", 617.28)]
    products = {r.item_code: (r.category, r.tab) for r in house.products.read().collect()}
    assert products["00123"] == ("Soda", "Drinks") and products["00124"] == ("Drinks", "Hot") and products["126"] == (None, None)
    unmatched = house.run_errors(run).where("error_stage = 'FACT'").first()
    assert unmatched.item_code == "126" and unmatched.error_reason == "NO_DIM_MATCH"
    assert house.run_errors(run).where("error_stage = 'SCAN'").count() == 1
    audit = {r.run_id: r for r in house.runs_latest().collect()}[run]
    assert (audit.status, audit.rows_in, audit.rows_cleaned, audit.rows_out) == ("SUCCEEDED", len(LINES), 4, 3)
    breakdown = json.loads(audit.removed_breakdown)
    assert breakdown["cleaner_errors"] == sum(REASONS.values()) and breakdown["by_reason"]["duplicates"] == {"duplicate row": 1}

    again = load.run_reports(spark, str(reports), catalogue, root)
    assert house.facts.read().count() == 3 and house.staged(again).count() == 0
    assert house.run_errors(again).where("error_stage = 'STAGING'").count() == 4
    assert len(house.products.versions()) == 2
    keys = [r.product_key for r in house.products.read().collect()]
    assert sorted(keys) == [1, 2, 3, 4]


def test_failed_run_can_be_loaded_again(spark, reports, catalogue, tmp_path, monkeypatch):
    root = str(tmp_path / "wh")
    with monkeypatch.context() as broken:
        broken.setattr(load, "load_facts", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            load.run_reports(spark, str(reports), catalogue, root)
    house = tables.Warehouse(spark, root)
    assert [(r.status, r.notes) for r in house.runs_latest().collect()] == [("FAILED", "lost")]
    load.run_reports(spark, str(reports), catalogue, root)
    assert house.facts.read().count() == 3


def test_stream_equals_batch(spark, reports, catalogue, tmp_path):
    write(reports, "june.csv", ["2023-06-01,R9,S1,00123,Coca-Cola 195ml,1,,10,8,2,Cash,C1"])
    batch, stream = str(tmp_path / "batch"), str(tmp_path / "stream")
    load.run_reports(spark, str(reports), catalogue, batch)
    query = ingest_reports(spark, str(reports), catalogue, stream, str(tmp_path / "cp"), files_per_batch=1)
    query.awaitTermination()
    assert query.exception() is None
    rows = [sorted(r.row_hash for r in tables.Warehouse(spark, root).facts.read().collect()) for root in (batch, stream)]
    assert rows[0] == rows[1] and len(rows[0]) == 4
    statuses = {r.status for r in tables.Warehouse(spark, stream).runs_latest().collect()}
    assert statuses == {"SUCCEEDED", "FAILED"}


def test_rule_order(spark):
    assert [r[1] for r in rules.reject_rules()][:4] == [
        "summary/total row matched 'grand total'", "summary/total row matched 'total:'",
        "summary/total row matched 'subtotal'", "completely empty row",
    ]


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Product Name,tab,CATEGORY,Barcode\nTea,Hot,Drinks,0012\n")
    rows = cat.read_catalogue(spark, str(tmp_path / "c.csv"))
    assert tuple(rows.first())[:5] == ("Tea", "Hot", "Drinks", "0012", None)
    assert cat.read_catalogue(spark, str(tmp_path / "missing.csv")).isEmpty()
    root = str(tmp_path / "saved")
    cat.save_catalogue(rows, root)
    cat.save_catalogue(rows.unionByName(rows), root)
    assert cat.load_saved_catalogue(spark, root).count() == 2
    assert tables.SnapshotTable(spark, root, CATALOGUE).read(1).count() == 1


def test_csv_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a")], "x string, y string")
    assert tables.save_rejects(rows.limit(0), str(tmp_path / "out.csv")) is None
    assert tables.save_rejects(rows, str(tmp_path / "out.csv")).endswith("out_errors")
    back = spark.read.option("header", "true").csv(str(tmp_path / "out_errors"))
    assert [tuple(r) for r in back.collect()] == [(None, "a")] and back.columns == ["x", "y"]


def test_date_dimension(spark):
    days = product.date_dimension(spark)
    assert days.count() == 9497
    first = days.where("date_key = date'2023-01-01'").first()
    assert (first.week, first.dow, first.is_weekend, first.quarter) == (52, 0, True, 1)


def test_catalogue_rows_follow_file_names(spark, tmp_path):
    """The later file is the larger one, which Spark would read first."""
    head = "Product Name,Tab,Category,Barcode,SKU Number\n"
    (tmp_path / "1.csv").write_text(head + "Tea,A,old,1,S\n")
    (tmp_path / "2.csv").write_text(head + "".join(f"Name {n},A,c,{n + 2},S\n" for n in range(500)) + "Tea,A,new,1,S\n")
    from tillflow.sources.catalogue import read_catalogue

    rows = read_catalogue(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(502))
    assert (rows[0].category, rows[-1].category) == ("old", "new")


def test_missing_file_does_not_stop_the_others(spark, tmp_path):
    from tillflow.plans.clean import clean_reports
    from tillflow.schema import REQUIRED_HEADER

    good = tmp_path / "good.csv"
    good.write_text(",".join(REQUIRED_HEADER) + "\n2023-01-01,R1,,1,Tea,1,0,10,8,2,Cash,C1\n")
    cleaned = clean_reports(spark, [str(good), str(tmp_path / "none.csv")])
    assert cleaned.lines.count() == 1
    assert sorted(r.status for r in cleaned.files.collect()) == ["FILE_NOT_FOUND", "OK"]


def test_quality_gate_stops_and_ignores_blank_lines(spark, tmp_path):
    from tillflow.plans.clean import clean_reports
    from tillflow.schema import REQUIRED_HEADER

    head = ",".join(REQUIRED_HEADER) + "\n"
    line = "2023-01-01,R1,,1,Tea,1,0,10,8,2,Cash,C1\n"
    (tmp_path / "blank.csv").write_text(head + line + ",,,,,,,,,,,\n" * 30)
    (tmp_path / "fires.csv").write_text(head + line + ",,,,,,,,,,Cash,C1\n" * 30)
    cleaned = clean_reports(spark, str(tmp_path))
    status = {r.file.rsplit("/", 1)[1]: r.status for r in cleaned.files.collect()}
    assert status == {"blank.csv": "OK", "fires.csv": "QUALITY_WARNING"}
    kept = {r["file"].rsplit("/", 1)[1]: r["count"] for r in cleaned.lines.groupBy("file").count().collect()}
    assert kept == {"blank.csv": 1, "fires.csv": 31}
