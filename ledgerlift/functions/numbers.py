"""Numbers in report text: tests and exact decimal parsing, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlift import lexicon as X
from ledgerlift.functions.common import col, strip


def _digits(c: Column) -> Column:
    """Sign, digits and dots of a printed number: '(5)' and '5-' are negative, Cr/Dr and commas go."""
    t = strip(c)
    t = F.regexp_replace(t, r"^(.*)[-−]$", "-$1")
    return F.regexp_replace(F.translate(t, "(", "-"), r"[^0-9.\-]", "")


def number_value(raw: Column) -> Column:
    """Exact value of a printed number; null for dates, unparsable text and magnitudes of a thousand million or more."""
    # plain numbers, nearly all, need no cleaning
    return F.when(raw.rlike(r"^-?\d+(?:\.\d+)?\z"), raw).when(~raw.rlike(X.DATE_LIKE), _digits(raw)).try_cast("decimal(18,9)")


def clean_number(c) -> Column:
    """Printed money to decimal(18,2); dates, unparsable text and values beyond the limit are 0."""
    return as_money(number_value(col(c)))


def clean_int(c) -> Column:
    """Printed quantity to bigint, truncating toward zero."""
    return as_whole(number_value(col(c)))


def as_money(value: Column) -> Column:
    return F.coalesce(F.round(value, 2).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def as_whole(value: Column) -> Column:
    return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))


def is_numeric(c) -> Column:
    """A token that is a printed number: no date, no letters or stars but CR/DR, at most 12 integer digits."""
    raw = col(c)
    letters = F.regexp_replace(F.upper(raw), "CR|DR", "")
    return raw.rlike(r"\d") & (
        raw.rlike(r"^-?\d{1,12}(?:\.\d*)?\z")  # plain: the tests below hold
        | (~raw.rlike(X.DATE_LIKE)
           & ~letters.rlike(r"[A-Z*]")
           & _digits(raw).rlike(r"^-?(?:\d{1,12}(?:\.\d*)?|\.\d+)$")))


def number_after(label: str, c) -> Column:
    """The number printed after a label ('Sub total : 1,234.50'), null when absent."""
    found = F.regexp_extract(col(c), rf"(?i){label}\s*:?\s*(-?\d+(?:,\d{{3}})*(?:\.\d+)?)", 1)
    return F.when(found != "", clean_number(found))


def fix_flat_digits(c) -> Column:
    """Digit misreadings of flat rows: B between digits or leading is 8, '.O' before digits is '.0'."""
    t = F.regexp_replace(col(c), r"(?<=\d)B(?=\d)|^B(?=\d)", "8")
    return F.regexp_replace(t, r"(?<=\d\.)O(?=\d)", "0")


def flat_number(c) -> Column:
    """Money of a flat row after the digit fixes."""
    t = F.regexp_replace(fix_flat_digits(strip(c)), r"[^0-9.\-]", "")
    return F.coalesce(t.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def date_key(c) -> Column:
    """dd-mm-yy(yy) as the comparable integer yyyymmdd; 2-digit years are 20yy; null when it is no date."""
    p = F.split(col(c), r"[-/]")
    year = F.get(p, F.lit(2)).try_cast("int")
    year = F.when(F.length(F.get(p, F.lit(2))) == 2, year + 2000).otherwise(year)
    return year * 10000 + F.get(p, F.lit(1)).try_cast("int") * 100 + F.get(p, F.lit(0)).try_cast("int")


def as_date(c) -> Column:
    """The DateType of a printed day-first date, null when the day does not exist."""
    return F.try_to_timestamp(date_key(c).cast("string"), F.lit("yyyyMMdd")).cast("date")
