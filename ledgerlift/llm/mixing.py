"""Mixing sources to target weights by iterative proportional fitting (raking), then calibrated sampling.

Documents are summed to cells of (source, lang, topic) weighted by their tokens. Raking multiplies the cells of a category by target over
current weight, one margin after the other, until no margin is off by more than TOLERANCE (relative) or after ROUNDS; the error of the
last round is reported as margin_error. The total stays. A cell's factor is raked over original weight.
A document's probability is its cell's factor times the rate, at most 1, where the rate is fitted so that the expected tokens are the
budget (`share` of all). A document is taken if its uniform number, from the md5 of its doc_id (of its text where that is null), lies
below its probability: the same document gets the same number in every run.

Margins are proportions by category; categories without a target share what the given ones leave, by the square root of their
weight; targets of categories without weight are spread over the others. Null categories are written as ''.
Topics come from the form of the text: 'table' (a | in one word of fifty or more), 'marked' (symbols likewise), 'long' (1,000 words or
more), 'prose' otherwise. Null and empty texts weigh nothing: probability 0, not taken. Rows are sampled one by one; rows that repeat a
doc_id share its number. Empty input gives empty output. Further columns pass through `sampled` unless named as one that it sets.

Cells are few against documents, but not bounded: sources may be many. So raking runs on the cell table, by grouped sums combined before
the shuffle and joins on the category, and is kept after every margin, so plans do not grow; the driver reads nothing but single sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep, words
from ledgerlift.llm.units import with_token_counts

DIMENSIONS = ["source", "lang", "topic"]
ROUNDS = 30
TOLERANCE = 1e-4
RATE_ROUNDS = 6
SETS = ["topic", "n_words", "n_tokens", "factor", "probability", "uniform", "taken", "margin_error"]


def topic_of(text: Column, n_words: Column) -> Column:
    count = lambda pattern: F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))
    return (F.when(50 * count("|") >= n_words, "table").when(50 * count("#*$%&<>") >= n_words, "marked")
            .when(n_words >= 1000, "long").otherwise("prose"))


def uniform_of(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.md5(text))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(2 ** 52)


def margins(cells: DataFrame, dimension: str, targets: dict[str, float]) -> DataFrame:
    """(dimension, target weight), in all as much as the cells weigh."""
    given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets.items()], f"{dimension} string, part double")
    joined = keep(cells.groupBy(dimension).agg(F.sum("w").alias("w")).filter("w > 0").join(given, dimension, "left"), f"margin-{dimension}")
    s = joined.agg(F.sum("w").alias("all"), F.sum("part").alias("given"), F.sum(F.when(F.col("part").isNull(), F.sqrt("w"))).alias("roots")).first()
    left = max(0.0, 1.0 - sum(targets.values())) if s["roots"] else 0.0
    whole = (s["given"] or 0.0) + left
    part = F.coalesce("part", F.lit(left) * F.sqrt("w") / F.lit(s["roots"] or 1.0))
    return joined.select(dimension, (part / whole * s["all"] if whole else F.col("w").cast("double")).alias(f"target_{dimension}"))


def raked(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, w) with `raked`, and margin_error: by how much a margin was off in the last round, at most."""
    now = cells.withColumn("raked", F.col("w").cast("double"))
    for d in DIMENSIONS:
        now = now.join(margins(cells, d, targets.get(d, {})), d).withColumn(f"step_{d}", F.lit(1.0))
    columns, error = now.columns, 0.0
    now = keep(now, "raked")
    for _ in range(rounds):
        for d in DIMENSIONS:
            have = F.sum("raked")
            step = now.groupBy(d).agg(F.when(have > 0, F.max(f"target_{d}") / have).otherwise(1.0).alias(f"step_{d}"))
            # kept after each margin: the cells are read twice here, and a plan of several margins would double with each
            now = keep(now.drop(f"step_{d}").join(step, d).withColumn("raked", F.col("raked") * F.col(f"step_{d}")).select(columns), "raked")
        error = now.agg(F.coalesce(F.max(F.greatest(*[F.abs(F.col(f"step_{d}") - 1) for d in DIMENSIONS])), F.lit(0.0)).alias("e")).first()["e"]
        if error <= tolerance:
            break
    return now.select(*DIMENSIONS, "w", "raked", F.lit(float(error)).alias("margin_error"))


def rated(cells: DataFrame, share: float) -> tuple[DataFrame, float]:
    """cells with `factor`, and the rate at which probabilities min(1, rate * factor) spend the budget."""
    cells = keep(cells.withColumn("factor", F.col("raked") / F.col("w")), "factors")
    rate = share
    for _ in range(RATE_ROUNDS):
        full = F.col("factor") * rate >= 1
        s = cells.agg(F.sum("w").alias("all"), F.sum(F.when(full, F.col("w"))).alias("full"), F.sum(F.when(~full, F.col("raked"))).alias("open")).first()
        if not s["open"]:
            break
        before, rate = rate, (share * s["all"] - (s["full"] or 0)) / s["open"]
        if rate == before:
            break
    return cells, rate


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]], share: float, tokenizer: str, columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns) with topic, n_words, n_tokens, factor, probability, uniform, taken and margin_error."""
    own = [c for c in columns or docs.columns if c not in SETS]
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.struct(*own).alias("m_row"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.size(words(F.col("text"))).cast("long").alias("n_words"),
                        uniform_of(F.col("doc_id"), text).alias("uniform"))
    rows = keep(with_token_counts(named.withColumn("topic", topic_of(F.col("text"), F.col("n_words"))), tokenizer), "weights")
    cells = keep(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("w")).filter("w > 0"), "cells")
    cells, rate = rated(raked(cells, targets), share)
    factors = cells.select(*DIMENSIONS, "factor", "margin_error")
    probability = F.when(F.col("n_tokens") > 0, F.least(F.lit(1.0), F.coalesce("factor", F.lit(0.0)) * float(rate))).otherwise(0.0)
    out = rows.join(factors, DIMENSIONS, "left").withColumn("probability", probability)
    return out.select(*[F.col("m_row")[c].alias(c) for c in own], "topic", "n_words", "n_tokens", "factor", "probability", "uniform",
                      (F.col("uniform") < F.col("probability")).alias("taken"), "margin_error")
