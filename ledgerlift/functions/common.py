"""Small helpers for building Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


NO_WORD = " \t\n\x0b\f\r0123456789.,:;-/%&()"  # left out when texts and words are compared by the rest of their characters


def strip(c, chars: str = r"\s") -> Column:
    """Remove the given regex character class from both ends."""
    return F.regexp_replace(col(c), rf"^[{chars}]+|[{chars}]+$", "")


def squeeze(c) -> Column:
    """Runs of two or more blanks become one; both ends trimmed."""
    return strip(F.regexp_replace(col(c), r"\s{2,}", " "))


def fold(c, rules) -> Column:
    """Apply (pattern, replacement) rules in order."""
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, col(c))


def fold_rare(c, rules, sign: str) -> Column:
    """As fold, for rules that seldom hit: a text without `sign`, a cheap pattern that every text holds in which a rule hits, is left as it is."""
    return F.when(col(c).rlike(sign), fold(c, rules)).otherwise(col(c))


def has_any(c, words) -> Column:
    """True when the text holds any of the literal words; plain substring search, much cheaper than one big pattern.

    An expression is bound first: inside the search it would be evaluated once per word.
    """
    text = col(c)
    if len(words) == 1:
        return text.contains(words[0])
    held = lambda t: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: t.contains(w))
    return held(text) if isinstance(c, str) else let(text, held)


def any_of(words) -> str:
    """Pattern that finds any of the literal words. Words with a common beginning share it, so a place in the text is tried once per beginning."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])

    def tail(c: str, rest: list[str]) -> str:
        c = c if c.isalnum() else rf"\x{{{ord(c):x}}}"
        return c if "" in rest else f"{c}(?:{any_of(rest)})"

    return "|".join(tail(c, rest) for c, rest in heads.items())


def may_hold(c, words) -> Column:
    """False only for texts that hold none of the words. Digits, blanks and marks leave text and words before, so few places are left to search."""
    letters = sorted({w.translate({ord(x): None for x in NO_WORD}) for w in words})
    return F.lit(True) if "" in letters else F.translate(col(c), NO_WORD, "").rlike(any_of(letters))


def match_groups(c, pattern: str, n: int) -> Column:
    """Groups of an anchored pattern from a single match: element i is group i; null when the text does not match."""
    mark = "\u0001"
    parts = F.regexp_replace(col(c), pattern, mark + mark.join(f"${i}" for i in range(1, n + 1)))
    return let(parts, lambda r: F.when(r.startswith(mark), F.split(r, mark)))


def has_all(c, words) -> Column:
    return reduce(lambda a, b: a & b, [col(c).contains(w) for w in words]) if words else F.lit(True)


def words_of(c) -> Column:
    """Blank-separated words; an empty text has none."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def let(value: Column, fn) -> Column:
    """Evaluate `value` once and use it several times inside fn."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def first_group(c, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null when nothing matches."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def staged(df: DataFrame, *steps: dict) -> DataFrame:
    """Add columns step by step; each step sees the columns of the steps before it."""
    for step in steps:
        df = df.withColumns({k: col(v) for k, v in step.items()})
    return df


def money(c) -> Column:
    return col(c).cast("decimal(18,2)")


def settle(df: DataFrame, values: Column, keep=None) -> DataFrame:
    """Add the fields of a struct expression as columns, computed once per row.

    The struct goes through a one-element generator. Filters later in the plan are
    then not pushed through it, which would repeat long text expressions in every
    filter. `keep` takes the struct and drops the row when it is false.
    """
    one = F.array(values)
    names = df.select(values.alias("_v")).schema["_v"].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c not in names],
                     F.inline(one if keep is None else F.filter(one, keep)))
