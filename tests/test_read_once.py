"""Shared steps read a text, a number or a document's facts once, with the results of the long way."""

import random

from pyspark.sql import functions as F

from ledgerlift import lexicon as X
from ledgerlift.functions.common import has_any, may_hold
from ledgerlift.functions.rows import positional_item
from ledgerlift.operators import extract_rows as R
from ledgerlift.operators import extract_tables as T
from ledgerlift.operators.headers import agency_name, header_facts


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_that_may_be_held(spark):
    rng = random.Random(3)
    for words, fit in ((X.TABLE_TRIGGERS, str.upper), ([*X.SKIP_HEADERS, *X.BLOCK_WORDS, *X.MODIFIER_WORDS], str.lower)):
        texts = [None, "", "12 x/7"] + [fit("".join(rng.choice([w, w[1:], w[:-1], " 7", ".", "zz"]) for w in rng.choices(words, k=rng.randint(1, 3)))) for _ in range(1500)]
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(may_hold("t", words).alias("may"), has_any("t", words).alias("has")).collect()
        assert all(r.may for r in rows if r.has) and not all(r.may for r in rows if r.may is not None)
    assert spark.range(1).select(may_hold(F.lit("a"), ["7 %", "b"])).first()[0]  # a word of left-out marks alone


def test_numbers_of_a_row_are_read_once(spark):
    df = spark.createDataFrame([(["5", "2", "1.50", "15.00"], True), (["5", "-", "3.00", "15.00", "2.5"], False), (["2.999", "7.00"], False),
                                (["4", "10.00", "40.00", "5.00"], False), ([], True), (["x"], True)], "nums array<string>, dated boolean")
    item = df.select(positional_item("nums", F.col("dated")).alias("i"))
    assert plan(item).lower().count("decimal(18,9)") < 8  # 13 casts before
    got = [tuple(float(v) for v in r.i) for r in item.collect()]
    assert got == [(5, 2, 1.5, 15, 0), (5, 0, 3, 15, 2.5), (2, 0, 0, 7, 0), (4, 0, 10, 40, 5), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]


def test_facts_are_written_once(spark):
    rows = [("a", 0, i, t) for i, t in enumerate(["PAGE 1 TRADERS", "12 SHARMA TRADERS", "PERIOD 01-02-2003 TO 28-02-2003", "LANE 5", "M/S ANN, PARK", "PRODUCT QTY", "05-05-2005 x"])]
    lines = spark.createDataFrame([*rows, ("b", 0, 0, None), ("b", 0, 1, "  "), ("c", 0, 3, " MEERA MEDICALS 2003-04 "), ("c", 0, 3, " ANNA TRADERS ")],
                                  "doc_id string, page_no int, line_no long, text string")
    facts = R.doc_facts(lines)
    assert "Aggregate" not in plan(facts) and "Join" not in plan(facts)  # every reader grouped the address lines again
    got = {r.doc_id: r for r in facts.collect()}
    assert (got["a"].from_date, got["a"].to_date, got["a"].party, got["a"].agency_name) == ("01-02-2003", "28-02-2003", "ANN", "ANN, PARK")
    assert got["b"].agency_name is None and got["c"].agency_name == "ANNA TRADERS"
    assert spark.range(1).select(agency_name(F.lit("M/S MEERA MEDICALS 2003-04"))).first()[0] == "MEERA MEDICALS"
    # the first dated line alone is cut into dates, after the grouping
    assert "regexp_extract_all" in plan(header_facts(lines))


def test_words_of_a_tax_row_are_judged_once(spark):
    row = "1. 20 10TAB ALFA BETA CAP K77 12/26 5 30049099 12.50 8.00 0.10 0.20 0.20 160.00"
    df = T._front(spark.createDataFrame([("d", 0, 1000, row)], "doc_id string, page_no int, line_no long, row string"))
    text = plan(df)
    assert text.lower().count("endswith(upper") <= 2  # several times for each use of a word before
    r = df.first()
    assert (r.qty, r.packing, r.batch, r.expiry, r.brand, r.dosage) == (20, "10TAB", "5", "12/26", "ALFA BETA K77", "CAP")
