"""Expressions that skip work for usual texts, against the long way on odd ones."""

import random

from pyspark.sql import functions as F

from ledgerlift import lexicon as X
from ledgerlift.functions.common import any_of, fold, has_any, strip
from ledgerlift.functions.numbers import _digits, clean_int, clean_number, is_numeric
from ledgerlift.functions.text import CONTROL, clean_line
from ledgerlift.operators import extract_rows as R
from ledgerlift.operators.headers import read_lines

ODD = ["", "5", "-5", "5-", "(5)", "5.", ".5", "1,234.50", "1234.5Cr", "12DR", "12-05", "12/5/24", "1*", "9" * 13, "9" * 13 + ".5", "--5", "5.5.5", "-",
       "12\u0085", "12\n", "١٢", "1e5", "+5", "12.50−", "A12.5", "0012", "-.5", "5cR", "5ß", "5ı", "5ﬁ", "CCRR5", None]


def test_numbers_as_the_long_way(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("0123456789.,-/(CRD* ") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    value = F.when(~F.col("t").rlike(X.DATE_LIKE), _digits(F.col("t"))).try_cast("decimal(18,9)")
    numeric = (F.col("t").rlike(r"\d") & ~F.col("t").rlike(X.DATE_LIKE) & ~F.regexp_replace(F.upper("t"), "CR|DR", "").rlike(r"[A-Z*]")
               & _digits(F.col("t")).rlike(r"^-?(?:\d{1,12}(?:\.\d*)?|\.\d+)$"))
    for r in df.select("t", is_numeric("t").alias("a"), numeric.alias("b"), clean_number("t").alias("c"), clean_int("t").alias("e"),
                       F.coalesce(F.round(value, 2).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).alias("d"),
                       F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint")).alias("f")).collect():
        assert (r.a, r.c, r.e) == (r.b, r.d, r.f), r


def test_clean_line_as_the_long_way(spark):
    rng = random.Random(6)
    parts = ["(cid:12)", "\x01", "==", "---", "A12-05", "AB12.5", "12.5ml", "1.5O", "12.50Q", "comer", "Custmer", "CSTOMER", "x", " ", "12/2024", "é", "\n", "7"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    long_way = strip(fold("t", [
        (r"\(cid:\d+\)", " "), (CONTROL, ""), (r"={2,}|-{3,}", " "), (r"([A-Za-z])(\d{1,2}[-/]\d{2,4})\b", "$1 $2"),
        (r"([A-Za-z])(\d+[\.,]\d{1,2})\b", "$1 $2"), (r"\b(\d+[\.,]\d{1,2})([A-Za-z])", "$1 $2"), (r"(?<=\d\.\d{1,2})[OoQq]\b", "0"),
        (X.CUSTOMER_MISSPELLINGS, "CUSTOMER")]))
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean_line("t").alias("a"), long_way.alias("b")).collect():
        assert r.a == r.b, r


def test_text_is_made_once_for_all_words(spark):
    """An expression inside the search would be evaluated once per word."""
    plan = spark.range(1).select(has_any(F.upper(F.regexp_replace(F.col("id").cast("string"), "1", "2")), ["A", "B"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(upper" not in plan and "contains(upper" not in plan.lower()


def test_words_by_one_pattern(spark):
    rng = random.Random(7)
    words = [*X.SKIP_HEADERS, *X.BLOCK_WORDS, *X.MODIFIER_WORDS, "a|b", "é.", "a", "ab\\", "^x"]
    texts = [None, ""] + ["".join(rng.choice([w, w[1:], w[:-1]]) for w in rng.choices([*words, "q ", "tot", "7"], k=rng.randint(1, 4))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for some in (words, words[:60], words[-1:]):
        for r in df.select("t", F.col("t").rlike(any_of(some)).alias("a"), has_any("t", some).alias("b")).collect():
            assert r.a == r.b, r


def test_lines_are_cleaned_once_and_stores_split_at_headings(spark):
    """Facts and rows read the written clean text; the store of a heading is not split again in each row."""
    rows = [("a", 0, i, t) for i, t in enumerate(["SHARMA TRADERS", "CUSTOMER : ANN MEDICALS, PARK", "PRODUCT NAME QTY FREE AMOUNT", "FIRST ITEM 1 0 5.00",
                                                  "MEERA MEDICAL STORE, HILL", "SECOND ITEM 2 1 7.50", "---", "", "THIRD ITEM 3 0 9.00"])]
    lines = read_lines(spark.createDataFrame(rows, "doc_id string, page_no int, line_no long, text string"))
    assert read_lines(lines) is lines
    facts = R.doc_facts(lines)
    assert "(cid" not in R.annotate(lines, facts, "SUMMARY")._jdf.queryExecution().optimizedPlan().toString()
    items = R.customer_product_items(lines, facts)
    assert X.GLUED_TRADE_WORD not in items._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.description, r.store_name, r.store_location, r.qty) for r in items.collect()}
    assert got == {("FIRST ITEM", "ANN MEDICALS", "", 1), ("SECOND ITEM", "MEERA MEDICAL STORE", "HILL", 2), ("THIRD ITEM", "MEERA MEDICAL STORE", "HILL", 3)}
