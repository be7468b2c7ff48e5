"""What keeps the cost of a line down: compiled code, one parse, one sort of the text."""

from pyspark.sql import functions as F

from tillflow.functions import dates, money, units
from tillflow.operators import rules
from tillflow.schema import REQUIRED_HEADER
from tillflow.session import METHOD_LIMIT, materialise
from tillflow.sources import records, reports

LIMIT = "spark.sql.codegen.hugeMethodLimit"
HEADER = ",".join(REQUIRED_HEADER)


def test_sessions_made_elsewhere_split_code_the_jvm_would_not_compile(spark):
    other = spark.newSession()
    other.conf.set(LIMIT, "65535")
    assert materialise(other.range(3), "few").count() == 3
    assert other.conf.get(LIMIT) == METHOD_LIMIT
    other.conf.set(LIMIT, "4000")
    materialise(other.range(3), "few")
    assert other.conf.get(LIMIT) == "4000"


def _recorded(monkeypatch, module):
    kept = []

    def record(df, label):
        stored = materialise(df, label)
        kept.append((label, stored))
        return stored

    monkeypatch.setattr(module, "materialise", record)
    return kept


def test_each_record_is_parsed_and_its_text_sorted_once(spark, tmp_path, monkeypatch):
    line = ",".join(["2024-01-0{}"] + ["1"] * (len(REQUIRED_HEADER) - 1))
    plain = [HEADER, *[line.format(i) for i in range(1, 6)]]
    torn = [HEADER, line.format(1), line.format(2).replace(",1", ',"a\n""b"', 1), line.format(3)]
    (tmp_path / "plain.csv").write_text("\n".join(plain))
    (tmp_path / "torn.csv").write_text("\n".join(torn))
    stored, texts = _recorded(monkeypatch, reports), _recorded(monkeypatch, records)
    rows, files = reports.store_rows(reports.read_scan(spark, str(tmp_path)))
    assert rows.count() == 10 and files.where(F.col("status") == "OK").count() == 2
    assert sum(df.count() for label, df in stored if label == "rows") == 10
    assert [label for label, df in [*stored, *texts] if "value" in df.columns] == ["quotes"]


def test_shortened_parsing_gives_the_same_values(column):
    amounts = ["1,234.50 CR", "12.5 dr", "12-", "(12)", "( 1,5 )", "abc", None, "", " 7 ", "1.234,5", "PHP 3.5", "-4 CR", "crab 5", "1,2,3-"]
    assert column(money.money_parse, amounts) == [
        -1234.5, 12.5, -12.0, -12.0, -1.5, None, None, None, 7.0, 1234.5, 3.5, None, 5.0, None]
    words = ["195ml", "TABLET (x)", "tabs box", "cancan", "", None, "3 capsules", "boxer box"]
    assert column(units.unit_from_description, words) == ["ml", "TABLET", "tabs", None, None, None, "capsules", "box"]
    assert column(rules.summary_pattern, ["a Grand TOTAL", "TOTAL: 3", "SubTotal", "totals", None]) == [
        "grand total", "total:", "subtotal", None, None]


def test_expiry_dates_of_both_orders_are_found(spark):
    texts = ["a EXP 2026-01-02", "b exp: 3/15/2026", "c 12/31/25 BB", "d 2027-02-03", "e exp", "f 1-2/3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [(str(r.e) if r.e else None, r.b) for r in dates.split_expiry(rows, "t", "e", "b").collect()]
    assert found[:4] == [("2026-01-02", "a"), ("2026-03-15", "b"), ("2025-12-31", "c"), ("2027-02-03", "d")]
    assert [e for e, _ in found[4:]] == [None, None]


def test_cells_of_a_lenient_line_lose_their_quotes_without_a_pattern(column):
    lines = ['a,"b, c",""', '"x ""y""",",', '"', '"two\nlines",3', ',"', None]
    assert column(reports.line_cells, lines) == [
        ["a", "b, c", ""], ['x "y"', '"', ""], ['"'], ["two\nlines", "3"], ["", '"'], None]
    assert "RLIKE" not in str(reports.line_cells(F.col("v"))).upper()
