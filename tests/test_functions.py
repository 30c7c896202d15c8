from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlift.functions import numbers as N
from ledgerlift.functions.entities import split_store
from ledgerlift.functions.rows import largest, peel, period_total, positional_item
from ledgerlift.functions.text import billable_units, clean_line


def one(spark, values, *exprs):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [tuple(r)[0] if len(exprs) == 1 else tuple(r) for r in df.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()]


def test_clean_number(spark):
    cases = {"1,234.56": "1234.56", "(5.00)": "-5.00", "5.5-": "-5.50", "12Cr": "12.00", "12-05-24": "0.00", "abc": "0.00",
             "1.2.3": "0.00", "9999999999": "0.00", "7.999": "8.00", "-": "0.00", ".5": "0.50", "": "0.00"}
    assert one(spark, cases, N.clean_number("t")) == [Decimal(v) for v in cases.values()]


def test_clean_int_truncates(spark):
    assert one(spark, ["3.99", "-3.99", "x", "1,200"], N.clean_int("t")) == [3, -3, 0, 1200]


def test_is_numeric(spark):
    cases = {"1,234.56": True, "12Cr": True, "B12": False, "12*": False, "12/05": False, "1234567890123": False, "(4)": True, "-": False}
    assert one(spark, cases, N.is_numeric("t")) == list(cases.values())


def test_peel_and_positional(spark):
    toks = F.split("t", " ")
    rows = one(spark, ["ONE 625 TAB 10 2 5.00 50.00", "A 1 2 3 0 12.50 30049099", "X 5 a b c d e"], peel(toks))
    assert rows[0].nums == ["10", "2", "5.00", "50.00"] and rows[0].words == ["ONE", "625", "TAB"]
    assert rows[1].nums == ["1", "2", "3", "0", "12.50"] and rows[1].words == ["A", "30049099"]
    assert rows[2].nums == []
    item = one(spark, ["10 2 5.00 50.00", "10 9.00 45.00 5", "7 70.00"], positional_item(toks, F.lit(False)))
    assert (item[0].qty, item[0].free, item[0].amount) == (10, 2, Decimal("50.00"))
    assert (item[1].rate, item[1].amount, item[1].percent) == (Decimal("9.00"), Decimal("45.00"), Decimal("5.00"))
    assert (item[2].qty, item[2].amount) == (7, Decimal("70.00"))


def test_period_total_and_largest(spark):
    toks = F.split("t", " ")
    assert one(spark, ["60 10 20 30", "10 20 30 60", "5 -90 7"], period_total(toks)) == [Decimal("60.00"), Decimal("60.00"), Decimal("-90.00")]
    assert one(spark, ["5 -90 7"], largest(toks)) == [Decimal("-90.00")]


def test_clean_line(spark):
    # a number is first parted from the letter behind it, so the O-for-0 rule only reaches numbers glued to a word
    assert one(spark, ["AB12-24 (cid:3)x 10.5O custmer == 1.25KG", "QTY1.50O"], clean_line("t")) == [
        "AB 12-24  x 10.5 O CUSTOMER   1.25 KG", "QTY1.500"]


def test_split_store(spark):
    cases = {"SHARMA MEDICAL STORE AMBALA CITY": ("SHARMA MEDICAL STORE", "AMBALA CITY"),
             "DR. RAKESH KUMAR MBBS KARNAL": ("DR. RAKESH KUMAR MBBS", "KARNAL"), "A1 TRADERS, SECTOR 5 LUPIN LTD": ("A1 TRADERS", "SECTOR 5"),
             "RAM KUMAR-PANIPAT": ("RAM KUMAR", "PANIPAT"), "XYZMEDICALS PVT LTD": ("XYZ MEDICALS", ""), "DR SINGH AMRITSAR": ("DR SINGH", "AMRITSAR")}
    df = spark.createDataFrame([(v,) for v in cases], "t string")
    got = {r.t: (r.store_name, r.store_location) for r in split_store(df, "t").collect()}
    assert got == cases


def test_billable_units(spark):
    got = one(spark, ["pdf", "png", "csv", "doc"], billable_units("t", F.lit(4), F.lit(101)))
    assert got == [4, 3, 3, 0]
