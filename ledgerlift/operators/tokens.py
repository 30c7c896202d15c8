"""Positioned tokens (document, page, text, box, confidence) to rows, columns and tab text.

A page is one image, so what is gathered per page (distinct heights on the page,
200 histogram buckets, the tokens of one row) is bounded by the paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.functions.common import let

# Confidence floor, row tolerance, histogram shape.
MIN_CONFIDENCE, MIN_TOLERANCE, BUCKETS = 0.45, 15.0, 200
GAP_SHARE, MIN_SEPARATION, MIN_COLUMNS = 0.20, 0.02, 5
PAGE = ["doc_id", "page_no"]


def legible(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("confidence") >= MIN_CONFIDENCE)


def assign_rows(tokens: DataFrame) -> DataFrame:
    """Row number of each token: going down the page, a token more than the tolerance below the row's first opens a row."""
    page = legible(tokens).groupBy(*PAGE).agg(
        F.greatest(F.percentile("height", 0.5), F.lit(MIN_TOLERANCE)).alias("tolerance"),
        F.sort_array(F.collect_set("center_y")).alias("ys"))
    none = F.array().cast("array<double>")
    anchors = F.aggregate("ys", none, lambda acc, y: F.when(
        (F.size(acc) == 0) | (y - F.try_element_at(acc, F.lit(-1)) > F.col("tolerance")), F.array_append(acc, y))
        .otherwise(acc))
    rows = page.select(*PAGE, anchors.alias("anchors"))
    at = F.size(F.filter("anchors", lambda a: a <= F.col("center_y"))) - 1
    return legible(tokens).join(rows, PAGE).withColumn("row_no", at.cast("bigint")).drop("anchors")


def column_boundaries(tokens: DataFrame) -> DataFrame:
    """Left column edges per page from the histogram of token centres; no edges when the page is under 10 wide."""
    centre = (F.col("min_x") + F.col("max_x")) / 2.0
    t = legible(tokens).withColumn("cx", centre)
    span = t.groupBy(*PAGE).agg(F.min("cx").alias("x0"), (F.max("cx") - F.min("cx")).alias("width"))
    wide = span.where(F.col("width") >= 10)
    bucket = F.least(F.floor((F.col("cx") - F.col("x0")) / F.col("width") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    counts = t.join(wide, PAGE).groupBy(*PAGE, "x0", "width", bucket.alias("b")).agg(F.count("*").alias("n"))
    pages = counts.groupBy(*PAGE, "x0", "width").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    spine = F.sequence(F.lit(0), F.lit(BUCKETS - 1))

    def at(i):
        return F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0))

    smooth = F.transform(spine, lambda i: (at(i - 1) + at(i) + at(i + 1)) / F.lit(3.0))

    def gap_starts(low_flags):
        starts = F.filter(spine, lambda i: F.get(low_flags, i) & ((i == 0) | ~F.coalesce(F.get(low_flags, i - 1), F.lit(True))))
        return F.transform(starts, lambda i: F.col("x0") + i / F.lit(float(BUCKETS)) * F.col("width"))

    def gaps(s):
        flags = let(F.array_max(s) * GAP_SHARE, lambda low: F.transform(s, lambda v: v < low))
        return let(flags, gap_starts)

    none = F.array().cast("array<double>")
    kept = F.aggregate(F.col("edges"), none, lambda acc, x: F.when(
        (F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) >= F.col("width") * MIN_SEPARATION),
        F.array_append(acc, x)).otherwise(acc))
    return pages.withColumn("edges", let(smooth, gaps)).select(*PAGE, kept.alias("boundaries"))


def row_texts(tokens: DataFrame) -> DataFrame:
    """One text line per row: by column slot when the page has at least five columns, by the gaps otherwise."""
    placed = assign_rows(tokens).join(column_boundaries(tokens), PAGE, "left")
    b = F.coalesce(F.col("boundaries"), F.array().cast("array<double>"))
    width = F.greatest(F.col("max_x") - F.col("min_x"), F.lit(1.0))
    right = F.array_append(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))),
                           F.try_element_at(b, F.lit(-1)) + width * 3)
    overlap = F.zip_with(b, right, lambda lo, hi: F.least(F.col("max_x"), hi) - F.greatest(F.col("min_x"), lo))
    slot = let(overlap, lambda o: F.when(F.array_max(o) > -1.0, F.array_position(o, F.array_max(o)).cast("int") - 1)
               .otherwise(F.lit(0)))
    placed = placed.withColumns({"slot": F.when(F.size(b) >= MIN_COLUMNS, slot), "n_columns": F.size(b)})
    line = Window.partitionBy(*PAGE, "row_no").orderBy("min_x", "max_x", "text")
    gap = F.col("min_x") - F.lag("max_x").over(line)
    cw = F.avg("char_width").over(Window.partitionBy(*PAGE, "row_no"))
    cw = F.when(cw == 0, 8.0).otherwise(cw)
    sep = (F.when(gap.isNull(), "").when(gap < 0, " ").when(gap <= cw, "").when(gap <= 3.5 * cw, " ").otherwise("\t"))
    ready = placed.withColumn("sep", sep).groupBy(*PAGE, "row_no").agg(
        F.max("n_columns").alias("n_columns"),
        F.array_sort(F.collect_list(F.struct("min_x", "max_x", "text", "sep", "slot"))).alias("cells"))
    by_slot = F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda i: F.array_join(
        F.transform(F.filter("cells", lambda c: c["slot"] == i), lambda c: c["text"]), " "))
    slotted = F.regexp_replace(F.array_join(by_slot, "\t"), r"\t+$", "")
    spaced = F.array_join(F.transform("cells", lambda c: F.concat(c["sep"], c["text"])), "")
    return ready.select(*PAGE, "row_no", F.size("cells").cast("bigint").alias("n_tokens"),
                        F.when(F.col("n_columns") >= MIN_COLUMNS, slotted).otherwise(spaced).alias("text"))


def mean_confidence(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean confidence weighted by text length."""
    weight = F.greatest(F.lit(1), F.length("text"))
    return tokens.groupBy(*(keys or ["doc_id"])).agg(
        (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("mean_confidence"))
