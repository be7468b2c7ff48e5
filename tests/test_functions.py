import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillflow.functions import dates, money, text, txn, units

MONEY = {
    "1,234.56": 1234.56, "1.234,56": 1234.56, "1.234.567,89": 1234567.89, "1,234,567.89": 1234567.89, "12,5": 12.5,
    "100-": -100.0, "100 CR": -100.0, "100 DR": 100.0, "-5 CR": None, "(1,234.56)": -1234.56, "1,234": 1.234,
    "1,234,567": None, "abc": None, "": None, "$ 7": 7.0, ".5": 0.5, "  12  ": 12.0, "1.2.3": None, "1,234.567,89": None,
}


def test_money(column):
    assert column(money.money_parse, list(MONEY)) == list(MONEY.values())


def test_money_switches(column):
    assert column(lambda c: money.money_parse(c, paren_negative=False), ["(5)"]) == [5.0]
    assert column(lambda c: money.money_parse(c, thousands_comma=True), ["1,234", "1,234,567", "12,5"]) == [1234.0, 1234567.0, 12.5]


def test_numeric_clean(column):
    cases = {"$12.50": 12.5, "(3)": -3.0, "1.234,5": 1234.5, "12.50-": None, "-4": -4.0, "nan": None, None: None}
    assert column(money.numeric_clean, list(cases)) == list(cases.values())
    assert column(money.strict_numeric, ["1,5", "-2.5x"]) == [15.0, -2.5]
    assert column(money.plain_number, ["1e3", " 2 ", "1,5", "1d", "NaN"]) == [1000.0, 2.0, None, None, None]


def test_dates(column):
    cases = {
        "2023-01-05": dt.datetime(2023, 1, 5), "1/2/2023": dt.datetime(2023, 1, 2), "12-31-2023": dt.datetime(2023, 12, 31),
        "1/2/98": dt.datetime(1998, 1, 2), "1/2/24": dt.datetime(2024, 1, 2), "13/45/2023": None, "1970-01-01": None,
        "2023-01-05 14:30:00": dt.datetime(2023, 1, 5, 14, 30), "3/4/2023 7:05": dt.datetime(2023, 3, 4, 7, 5),
        "Jan 5, 2023": dt.datetime(2023, 1, 5), "5 Feb 2023": dt.datetime(2023, 2, 5), "20230105": dt.datetime(2023, 1, 5),
        "2023-01-15 14:30:00.123": dt.datetime(2023, 1, 15, 14, 30, 0, 123000), "2023-01-15T14:30:00Z": dt.datetime(2023, 1, 15, 14, 30),
        "1/15/23 14:30": dt.datetime(2023, 1, 15, 14, 30), "1/15/23 2:30 PM": dt.datetime(2023, 1, 15, 14, 30),
        "01/15/2023 2:30:15 PM": dt.datetime(2023, 1, 15, 14, 30, 15), "2023/01/15 14:30": dt.datetime(2023, 1, 15, 14, 30),
        "January 5, 2023": dt.datetime(2023, 1, 5), "Jan 5, 2023 2:30 PM": dt.datetime(2023, 1, 5, 14, 30),
        "5 January 2023": dt.datetime(2023, 1, 5), "2023.01.15": dt.datetime(2023, 1, 15), "Nov 2024": dt.datetime(2024, 11, 1),
        "3/4/2023 7:05 PM": dt.datetime(2023, 3, 4, 19, 5), "soon": None, "": None, "12:30": None, "12345": None,
        "2023-02-30": None, None: None,
        "2023-01-15T14:30:00+08:00": dt.datetime(2023, 1, 15, 14, 30), "2023-01-15 02:30 -0500": dt.datetime(2023, 1, 15, 2, 30),
        "1/15/2023 02:30:00 +0800": dt.datetime(2023, 1, 15, 2, 30), "Sun, 15 Jan 2023": dt.datetime(2023, 1, 15),
        "Sunday 2023-01-15": dt.datetime(2023, 1, 15), "Wed, 1/18/2023": dt.datetime(2023, 1, 18),
        "Monday, January 16, 2023": dt.datetime(2023, 1, 16), "Sunshine": None, "2023-01-15+08": None,
    }
    assert column(dates.clean_date, list(cases)) == list(cases.values())


def test_expiry(column):
    cases = {"2024-11-01": dt.date(2024, 11, 1), "3/15/2026": dt.date(2026, 3, 15), "2011-01-01": None, "2046-01-01": None}
    assert column(dates.normalise_expiry, list(cases)) == list(cases.values())
    assert column(dates.lenient_expiry_text, ["3/5/2011", "soon"]) == ["2011-03-05", "soon"]


@pytest.mark.parametrize("description, bare, expiry", [
    ("Gel #EXP2024-11-01", "Gel", dt.date(2024, 11, 1)),
    ("Syrup exp: 3/15/2026", "Syrup", dt.date(2026, 3, 15)),
    ("Milk 12/31/25 BB", "Milk", dt.date(2025, 12, 31)),
    ("Tea 2024-11-01", "Tea", dt.date(2024, 11, 1)),
    ("Old EXP 2011-01-01", "Old EXP 2011-01-01", None),
    ("Plain", "Plain", None),
    ("2024-11-01", "2024-11-01", dt.date(2024, 11, 1)),
    (None, None, None),
    ("Cream  best by 1-2-2027 x #expired", "Cream x", dt.date(2027, 1, 2)),
])
def test_expiry_in_description(spark, description, bare, expiry):
    rows = spark.createDataFrame([(description,)], "d string")
    assert tuple(dates.split_expiry(rows, "d", "e", "b").select("b", "e").first()) == (bare, expiry)


def test_text(column):
    assert column(text.clean_text, [" a ", "NaN", "none", "\t\xa0", "NONE", "x "]) == ["a", None, None, None, "NONE", "x"]
    assert column(text.clean_item_code, [" ab1 "]) == ["AB1"]
    assert column(text.csv_missing_to_null, ["N/A", "<NA>", "a", ""]) == [None, None, "a", None]
    assert column(lambda c: text.number_text(c.cast("double")), ["12.5", "8", "8.00001", None]) == ["12.5", "8", "8.00001", None]


def test_names(column):
    same = column(text.basic_name, ["Gingerbon regular 125g", "GINGERBON REGULAR 125G", "gingerbon  regular 125g!"])
    assert set(same) == {"gingerbon regular 125g"}
    long = "Salonpas Plaster (methyl salicylate, menthol, and camphor) 20s"
    tagged = "SALONPAS PLASTER 20s #EXP2024-11-01"
    assert column(text.basic_name, [long]) == ["salonpas plaster methyl salicylate menthol and camphor 20s"]
    assert column(text.basic_name, [tagged]) == ["salonpas plaster 20s exp20241101"]
    assert column(text.improved_name, [long, tagged, None, "a [b] {c} #d e"]) == ["salonpas plaster 20s", "salonpas plaster 20s", "", "a e"]
    assert column(text.basic_name, ["Crème_1 ½ д"]) == ["crème_1 ½ д"]


def test_units(column):
    cases = {"PCS": "pcs", " Boxes ": "box", "pkt": "pack", "per kg": "kg", "grams": "g", "L": "l", "ml": "ml", "dozen": None,
             "tablet": "pcs", "3 pieces": "pcs", None: None}
    assert column(units.canonical_unit, list(cases)) == list(cases.values())
    found = column(units.unit_from_description, ["Cola 195ml", "Box of 3", "boxer", "tablets 10s", "Kgs", None])
    assert found == ["ml", "Box", None, "tablets", None, None]


def test_transaction_type(spark):
    rows = [("Senior discount", 1.0, "ADJUSTMENT"), ("exchange", 1.0, "ADJUSTMENT"), ("Tea", -1.0, "RETURN"),
            ("refund", 1.0, "RETURN"), ("Tea", 1.0, "SALE"), (None, None, "SALE")]
    found = spark.createDataFrame(rows, "d string, q double, want string").select(
        txn.txn_type(F.col("d"), F.col("q")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in found)


def test_measures(spark):
    rows = spark.createDataFrame([(10.0, 1.0, None), (None, 0.0, 2.0), (8.0, 0.0, 2.0), (None, 1.0, None)], "s double, q double, d double")
    s, q, d = F.col("s"), F.col("q"), F.col("d")
    got = [tuple(r) for r in rows.select(txn.unit_price(s, q), txn.discount_rate(s, d), txn.gross_amount(s, d)).collect()]
    assert got == [(10.0, 0.0, 10.0), (None, None, None), (None, 0.2, 10.0), (None, None, None)]
