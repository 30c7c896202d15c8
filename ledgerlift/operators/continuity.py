"""Pages and lines made continuous: artifacts, hyphens, split rows, rebuilt rows, carried context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift import lexicon as X
from ledgerlift.functions.common import strip, words_of
from ledgerlift.operators.ordered import attach, neighbours, scan


def page_counts(lines: DataFrame) -> DataFrame:
    """Pages per document; partial aggregates keep a big document off one task."""
    return lines.groupBy("doc_id").agg((F.max("page_no") + 1).alias("n_pages"))


def drop_artifacts(lines: DataFrame) -> DataFrame:
    """Page numbers, 'page n', 'continued' and blank lines leave documents of more than one page."""
    t = strip("text")
    noise = t.rlike(X.PAGE_ARTIFACT) | (t == "")
    return (
        attach(lines, page_counts(lines), ["doc_id"], "line_no")
        .where((F.col("n_pages") <= 1) | ~noise).drop("n_pages")
    )


def merge_hyphens(lines: DataFrame) -> DataFrame:
    """A page whose first line is 'word-' gives that word to the last line kept of the pages before it.

    Only the first and last line of each page decide, so the work across pages runs
    on one small row per page and comes back as edits keyed by (document, line).
    """
    part = r"^(\w+)-$"
    pages = lines.groupBy("doc_id", "page_no").agg(
        F.min(F.struct("line_no", "text")).alias("head"), F.max("line_no").alias("tail"))
    pages = pages.withColumn("open", F.col("head.text").rlike(part))
    known = scan(pages, ["doc_id"], "page_no", lags={"seen": F.lit(1)},
                 fill={"host_upto": F.when(~F.col("open") | (F.col("tail") > F.col("head.line_no")), F.col("tail"))})
    # the host of an opening page lies before the page, so look at the value carried into it
    hosts = scan(known, ["doc_id"], "page_no", lags={"host": "host_upto"})
    moved = hosts.where(F.col("open") & F.col("seen").isNotNull())
    gone = moved.select("doc_id", F.col("head.line_no").alias("line_no"), F.lit(None).cast("string").alias("added"))
    added = moved.where(F.col("host").isNotNull()).groupBy("doc_id", F.col("host").alias("line_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("head")),
                                 lambda h: F.regexp_extract(h["text"], part, 1)), "").alias("added"))
    edits = gone.unionByName(added).groupBy("doc_id", "line_no").agg(
        F.max("added").alias("added"), F.max(F.col("added").isNull()).alias("leaves"))
    return (
        lines.join(edits, ["doc_id", "line_no"], "left")
        .where(~F.coalesce("leaves", F.lit(False)))
        .withColumn("text", F.concat("text", F.coalesce("added", F.lit(""))))
        .select(*lines.columns)
    )


def continuous_lines(lines: DataFrame) -> DataFrame:
    return merge_hyphens(drop_artifacts(lines))


def split_rows(lines: DataFrame) -> DataFrame:
    """Pairs of a line and its follower that look like one broken row, one result per reason."""
    near = neighbours(lines.withColumn("text", strip("text")), ["doc_id"], "line_no", 1,
                      lambda w: {"next_text": F.lead("text").over(w)})
    a, b = words_of("text"), words_of("next_text")

    def number(w):
        return F.replace(w, F.lit("."), F.lit("")).rlike(r"^\d+$")

    dangling = F.col("text").rlike("[-,]$")
    numeric = ((F.size(a) >= 3) & (F.size(b) >= 2)
               & number(F.try_element_at(a, F.lit(-1))) & number(F.try_element_at(b, F.lit(1))))
    reasons = F.array_compact(F.array(F.when(dangling, "dangling"), F.when(numeric, "numeric")))
    return (
        near.where((F.col("text") != "") & (F.col("next_text") != ""))
        .select("doc_id", "line_no", "text", "next_text", F.explode(reasons).alias("reason"))
    )


def rebuild_rows(lines: DataFrame, reach: int = 3) -> DataFrame:
    """Table rows put together: a line of at least four words takes up shorter number lines within `reach`.

    How many lines a row takes depends only on the lines right behind it. Which
    lines start a row depends on the rows before, but only inside short runs: a
    line no earlier line can reach starts a row for certain. Word counts fall
    strictly along any chain of reaches, so a run is at most `reach` times the
    longest line's word count - small, whatever the document - and is resolved by
    a fold over its own lines.
    """
    base = lines.select("doc_id", "line_no", strip("text").alias("text"))
    base = base.withColumn("n", F.size(words_of("text"))) \
        .withColumn("lead_num", F.exists(F.slice(words_of("text"), 1, 2),
                                         lambda w: F.replace(w, F.lit("."), F.lit("")).rlike(r"^\d+$")))
    def taken(w) -> dict:
        count, going = F.lit(0), F.col("n") >= 4
        for d in range(1, reach + 1):
            n, num = F.lead("n", d).over(w), F.lead("lead_num", d).over(w)
            going = going & n.isNotNull() & ((n == 0) | ((n >= 2) & (n < F.col("n")) & num))
            count = F.when(going, F.lit(d)).otherwise(count)
        return {"taken": count}

    def sure(w) -> dict:
        reached = F.lit(False)
        for d in range(1, reach + 1):
            reached = reached | (F.coalesce(F.lag("taken", d).over(w), F.lit(0)) >= d)
        return {"sure": (~reached).cast("bigint")}

    ranked = neighbours(base, ["doc_id"], "line_no", reach, taken, sure)
    runs = scan(ranked, ["doc_id"], sums={"run": "sure"})
    grouped = runs.groupBy("doc_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text", "taken"))).alias("rows"))
    start = F.struct(F.lit(0).alias("left"), F.array().cast("array<struct<line_no:bigint,text:string>>").alias("out"))

    def step(acc, r):
        fresh = F.struct(r["line_no"].alias("line_no"), r["text"].alias("text"))
        size = F.size(acc["out"])
        last = F.try_element_at(acc["out"], F.lit(-1))
        merged = F.struct(last["line_no"].alias("line_no"),
                          F.when(r["text"] == "", last["text"])
                          .otherwise(F.concat_ws(" ", last["text"], r["text"])).alias("text"))
        return F.struct(
            F.when(acc["left"] > 0, acc["left"] - 1).otherwise(r["taken"]).alias("left"),
            F.when(acc["left"] > 0, F.array_append(F.slice(acc["out"], F.lit(1), size - 1), merged))
            .otherwise(F.array_append(acc["out"], fresh)).alias("out"),
        )

    return (
        grouped.select("doc_id", F.explode(F.aggregate("rows", start, step)["out"]).alias("r"))
        .select("doc_id", "r.line_no", "r.text").where(F.col("text") != "")
    )
