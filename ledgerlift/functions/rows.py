"""Reading one report row: trailing numbers, positional meaning, running text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlift.functions.common import col, let, money
from ledgerlift.functions.numbers import as_money, as_whole, clean_number, is_numeric, number_value

MAX_TRAILING_JUNK = 4


def peel(tokens) -> Column:
    """Split tokens into leading words and the run of trailing numbers.

    Up to four junk tokens may follow the numbers. A whole number of 4 to 8
    digits behind a decimal number is a code and returns to the words.
    """
    toks = col(tokens)

    def from_right(flags: Column) -> Column:
        junk = F.array_position(flags, True).cast("int") - 1
        after = F.slice(flags, junk + 1, F.size(flags))
        gap = F.array_position(after, False).cast("int")
        run = F.when(gap > 0, gap - 1).otherwise(F.size(after))
        found = (junk >= 0) & (junk <= MAX_TRAILING_JUNK)
        return F.struct(
            F.when(found, junk).otherwise(F.least(F.size(flags), F.lit(MAX_TRAILING_JUNK))).alias("junk"),
            F.when(found, run).otherwise(F.lit(0)).alias("run"),
        )

    def cut(p: Column) -> Column:
        keep = F.size(toks) - p["junk"] - p["run"]
        nums = F.slice(toks, keep + 1, p["run"])
        words = F.slice(toks, F.lit(1), keep)
        return F.struct(words.alias("words"), nums.alias("nums"))

    def drop_code(r: Column) -> Column:
        last = F.get(r["nums"], F.size(r["nums"]) - 1)
        prev = F.get(r["nums"], F.size(r["nums"]) - 2)
        is_code = (
            (F.size(r["nums"]) >= 2)
            & ~last.contains(".")
            & F.length(F.regexp_replace(last, r"\D", "")).between(4, 8)
            & (prev.rlike(r"\d+\.\d{2}") | prev.isin("0", "0.0", "0.00"))
        )
        return F.struct(
            F.when(is_code, F.array_append(r["words"], last)).otherwise(r["words"]).alias("words"),
            F.when(is_code, F.slice(r["nums"], F.lit(1), F.size(r["nums"]) - 1)).otherwise(r["nums"]).alias("nums"),
        )

    flags = F.transform(F.reverse(toks), is_numeric)
    return let(let(let(flags, from_right), cut), drop_code)


def nth(nums, i: int) -> Column:
    """The i-th number token (negative counts from the end), '0' when absent."""
    n = col(nums)
    at = F.lit(i) if i >= 0 else F.size(n) + i
    return F.coalesce(F.get(n, at), F.lit("0"))


def keep_last(nums, n: int) -> Column:
    """The last n numbers of the row."""
    a = col(nums)
    return F.when(F.size(a) > n, F.slice(a, F.size(a) - n + 1, F.lit(n))).otherwise(a)


def overflow_words(nums, n: int) -> Column:
    """The numbers before the last n, as words."""
    a = col(nums)
    return F.when(F.size(a) > n, F.slice(a, F.lit(1), F.size(a) - n)).otherwise(F.array().cast("array<string>"))


def positional_item(nums, dated) -> Column:
    """qty, free, rate, amount and percent by how many numbers the row has."""
    # each number is read once; `nums` itself says what was printed
    values = F.transform(F.slice(col(nums), 1, 5), lambda x: number_value(x))
    return let(values, lambda read: _positional(col(nums), read, col(dated)))


def _positional(a: Column, read: Column, has_date: Column) -> Column:
    n = F.size(a)
    printed = nth(a, 1)
    v = [F.get(read, F.lit(i)) for i in range(5)]
    q, third, fourth = as_money(v[0]), as_money(v[2]), as_money(v[3])
    product = (q * third).cast("decimal(38,4)")
    fits = (q > 0) & (third > 0) & (F.abs(product - fourth) <= product * F.lit("0.3").cast("decimal(2,1)"))
    no_free = printed.isin("-", "0", "0.0", "0.00") & (fourth > third)
    priced = (n == 4) & (has_date | fits | no_free)   # qty, free, rate, amount
    percent4 = (n == 4) & ~priced                      # qty, rate, amount, percent
    return F.struct(
        as_whole(F.when(n >= 2, v[0])).alias("qty"),
        as_whole(F.when(priced | (n >= 5), v[1])).alias("free"),
        as_money(F.when((n == 3) | percent4, v[1]).when(priced | (n >= 5), v[2])).alias("rate"),
        as_money(F.when(n == 1, v[0]).when(n == 2, v[1]).when((n == 3) | percent4, v[2]).when(n >= 4, v[3])).alias("amount"),
        as_money(F.when(percent4, v[3]).when(n >= 5, v[4])).alias("percent"),
    )


def largest(nums) -> Column:
    """The number of largest magnitude, first on ties, with its sign."""
    values = F.transform(col(nums), clean_number)
    top = F.array_max(F.transform(values, lambda v: F.abs(v)))
    return F.coalesce(F.get(F.filter(values, lambda v: F.abs(v) == top), F.lit(0)), money(F.lit(0)))


def period_total(nums, tolerance: int = 2) -> Column:
    """Total of a row of period amounts: first if it equals the rest, last if it equals the others, else the largest."""
    def pick(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)"))
        first, last = F.get(v, F.lit(0)), F.get(v, F.size(v) - 1)
        return (
            F.when(F.size(v) == 1, first)
            .when(F.abs(first - (total - first)) <= tolerance, first)
            .when(F.abs(last - (total - last)) <= tolerance, last)
            .otherwise(largest(nums))
        )
    return F.when(F.size(col(nums)) > 0, money(let(F.transform(col(nums), clean_number), pick))) \
        .otherwise(money(F.lit(0)))


def join_words(*parts) -> Column:
    """Word arrays and texts joined by single blanks, empty ones left out."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *[col(p) for p in parts]), r"^\s+", ""))


def first_of(*candidates) -> Column:
    """First candidate that is neither null nor empty."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.nullif(col(c), F.lit("")) for c in candidates])
