"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD) per language and source.

Each text gives counts (words, symbols, repeated words and lines) and a transformed vector of four statistics: log mean word length,
and log(1 + percentage) of symbols per word, repeated words and repeated lines. Length itself is left to the base rule. For every
group of lang and source the MCD location and scatter come from concentration steps: start at median and interquartile range, keep
the three quarters of documents with the smallest Mahalanobis distance, estimate again, at last reweight. A document beyond the cutoff
is rejected. Scatter has a floor per statistic, so a statistic that is constant in a group does not condemn small differences.

Groups of fewer than `min_group` documents are pooled by lang, then over all; what is still smaller than `least` gives no verdict and is
kept. A step is one grouped sum over (group, distance bin): a hot source is combined before the shuffle, and the result does not
depend on task order but for float rounding. Only DataFrame functions.

Null texts have no words and fail the base rule (fewer than 50 words). lang and source may be null, which is a value of its own. Rows
are judged one by one: repeated rows repeat. Further columns pass through `judged` unless named as one that it sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlift.llm.common import BLANKS, keep, words

SYMBOLS = "#*$%&|<>"
FLOORS = (0.08, 0.5, 1.25, 1.25)  # least standard deviation of each statistic
CUTOFF = 40.0                     # squared Mahalanobis distance beyond which a document is rejected
COVERAGE = 0.75                   # part of a group that estimates its scatter
CONSISTENCY = 1.485               # of the scatter of the innermost three quarters, four normal statistics
REWEIGHT = 11.14                  # chi-square 0.975, 4 degrees
BIN = 0.05                        # width of distance bins, in log(1 + squared distance)
STEPS = 3
STATS = ["x1", "x2", "x3", "x4"]
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
SETS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]


def measured(docs: DataFrame) -> DataFrame:
    """docs with the counts of each text, in columns q_*; whole texts."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("q_words", words(F.col("text"))).withColumn(
        "q_lines", F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    windows = F.when(F.size("q_words") >= 3, F.transform(
        F.slice("q_words", F.lit(1), F.size("q_words") - 2),
        lambda w, i: F.xxhash64(w, F.get("q_words", i + 1), F.get("q_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("q_windows", windows)
    # windows found twice, by neighbours in order of hash
    ranked = F.when(F.size(F.array_distinct("q_windows")) < F.size("q_windows"),
                    F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("q_ranked", ranked)
    again = F.transform("q_ranked", lambda e, k: F.when(
        (F.get("q_ranked", k - 1)["h"] == e["h"]) | (F.get("q_ranked", k + 1)["h"] == e["h"]), e["i"]))
    out = out.withColumn("q_again", F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("q_again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("q_again", k + 1) - i, F.lit(3)))),
                          F.lit(0).cast("long"), lambda a, b: a + b)
    n = F.size("q_words").cast("long")
    return out.select(
        *docs.columns, n.alias("q_n_words"), F.length(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", "")).cast("long").alias("q_word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("q_n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("q_n_repeat_words"), F.size("q_lines").cast("long").alias("q_n_lines"))


def vectors(rows: DataFrame) -> DataFrame:
    n = F.greatest("q_n_words", F.lit(1))
    percent = lambda c, of: F.log1p(100.0 * F.col(c) / of)
    failed = (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))
    return (rows.withColumn("q_failed", failed)
            .withColumn("x1", F.log(F.greatest("q_word_chars", F.lit(1)) / n)).withColumn("x2", percent("q_n_symbols", n))
            .withColumn("x3", percent("q_n_repeat_words", n)).withColumn("x4", percent("q_n_dup_lines", F.greatest("q_n_lines", F.lit(1)))))


def grouped(rows: DataFrame, min_group: int) -> DataFrame:
    """(lang, source, group): the group that each lang and source is judged in."""
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    level = F.struct("lang", "source", F.lit(0).alias("pool"))
    by_lang = F.struct("lang", F.lit(None).cast("string").alias("source"), F.lit(1).alias("pool"))
    overall = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(2).alias("pool"))
    small = counts.filter(F.col("n") < min_group)
    langs = small.groupBy("lang").agg(F.sum("n").alias("of_lang")).withColumnRenamed("lang", "pool_lang")
    joined = counts.join(langs, F.col("lang").eqNullSafe(F.col("pool_lang")), "left")
    return joined.select("lang", "source", F.when(F.col("n") >= min_group, level).when(F.col("of_lang") >= min_group, by_lang).otherwise(overall).alias("group"))


def _distance(rows: DataFrame) -> Column:
    """Squared Mahalanobis distance by forward substitution with the group's Cholesky factor (columns l_i_j, m_i)."""
    z: list[Column] = []
    for i, x in enumerate(STATS):
        rest = reduce(lambda a, j: a - F.col(f"l_{i}_{j}") * z[j], range(i), F.col(x) - F.col(f"m_{i}"))
        z.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in z])


def _factored(groups: DataFrame) -> DataFrame:
    """From m_i and c_i_j (scatter) the Cholesky factor l_i_j, with floors added to the diagonal."""
    for i, j in PAIRS:
        base = F.col(f"c_{i}_{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), base)
        groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return groups.select("group", "n", *[f"m_{i}" for i in range(4)], *[f"l_{i}_{j}" for i, j in PAIRS])


def estimates(vectors_kept: DataFrame, least: int, steps: int = STEPS) -> DataFrame:
    """vectors_kept (group, x1..x4) to one row per group of at least `least` documents: group, n, location and Cholesky factor."""
    # on values rounded to 1/64, percentiles hold a bounded number of distinct values
    quartiles = [F.percentile(F.round(F.col(x) * 64) / 64, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(x) for x in STATS]
    start = vectors_kept.groupBy("group").agg(F.count("*").alias("n"), *quartiles).filter(F.col("n") >= least)
    start = start.select("group", "n", *[F.col(x)[1].alias(f"m_{i}") for i, x in enumerate(STATS)], *[
        (F.pow((F.col(STATS[i])[2] - F.col(STATS[i])[0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS])
    params = keep(_factored(start), "scatter")
    for step in range(steps + 1):
        last = step == steps
        near = vectors_kept.join(params, "group")
        binned = near.withColumn("bin", F.floor(F.log1p(_distance(near)) / BIN)).groupBy("group", "n", "bin").agg(
            F.count("*").alias("k"), *[F.sum(x).alias(f"s_{i}") for i, x in enumerate(STATS)],
            *[F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p_{i}_{j}") for i, j in PAIRS])
        below = F.coalesce(F.sum("k").over(W.partitionBy("group").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        inner = F.expm1(F.col("bin") * BIN) <= REWEIGHT if last else F.col("below") < COVERAGE * F.col("n")
        sums = binned.withColumn("below", below).filter(inner).groupBy("group", "n").agg(
            F.sum("k").alias("k"), *[F.sum(f"s_{i}").alias(f"s_{i}") for i in range(4)], *[F.sum(f"p_{i}_{j}").alias(f"p_{i}_{j}") for i, j in PAIRS])
        mean = lambda i: F.col(f"s_{i}") / F.col("k")
        scale = 1.0 if last else CONSISTENCY
        moved = sums.select("group", "n", *[mean(i).alias(f"m_{i}") for i in range(4)],
                            *[((F.col(f"p_{i}_{j}") / F.col("k") - mean(i) * mean(j)) * scale).alias(f"c_{i}_{j}") for i, j in PAIRS])
        params = keep(_factored(moved), "scatter")
    return params


def judged(docs: DataFrame, columns: list[str] | None = None, min_group: int = 100, least: int = 10, cutoff: float = CUTOFF) -> DataFrame:
    """docs (or the named columns of it) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (null
    without a verdict) and kept. The named columns are written to the shared folder once."""
    own = [c for c in columns or docs.columns if c not in SETS]
    plain = docs.select(F.struct(*own).alias("q_row"), "text", "lang", "source")
    rows = vectors(measured(plain).drop("text"))
    return _judged(rows, min_group, least, cutoff).select(*[F.col("q_row")[c].alias(c) for c in own], *SETS)


def _judged(rows: DataFrame, min_group: int, least: int, cutoff: float) -> DataFrame:
    rows = keep(rows, "quality")
    passed = rows.filter(~F.col("q_failed"))
    groups = keep(grouped(passed, min_group).withColumnsRenamed({"lang": "g_lang", "source": "g_source"}), "quality-groups")
    with_group = rows.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    params = estimates(with_group.filter(~F.col("q_failed")).select("group", *STATS), least)
    seen = with_group.join(params, "group", "left")
    seen = seen.withColumn("distance", F.when(~F.col("q_failed"), _distance(seen)))
    return seen.select(
        "q_row", *[F.col(f"q_{c}").alias(c) for c in SETS[:5]], F.col("q_failed").alias("base_failed"), "distance",
        (~F.col("q_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))).alias("kept"))
