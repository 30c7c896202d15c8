"""Repeated line runs by a suffix array over line-id sequences; later copies are deleted.

A document is the sequence of its lines that hold a word. Suffixes are ranked by prefix doubling: the rank of a block of 2^k lines is
the first place in the corpus where those lines stand, from the ranks of its two halves; suffixes alone in their rank leave, since
nothing longer repeats there. Suffixes of one rank are an interval of the suffix array with a common prefix of at least 2^k lines; two
overlapping ranks give the interval for any length between. From every line the shortest run of at least `min_words` words
is looked up that way, forwards and backwards; overlapping runs join to the maximal repeated ones. A run's first place in the order of
(doc_id, line) stays, later copies go. Since every line has a word, no run looked up is longer than `min_words` lines and doubling
ends there; longer repeats are unions of these runs, so no copied line is missed.

Only DataFrame functions. Ranks come from grouped minima (combined before the shuffle) joined back, so a very common line is no
single task; windows run within one document.

Lines are compared exactly, without their line feed. Lines without words never count and stay. Null texts have no lines and stay null.
A doc_id may be null (first in order) or repeat with different texts; rows equal in doc_id and text are one document and come out
alike. Further columns pass through `without_repeats`, but for those named n_lines and n_removed, which it sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlift.llm.common import BLANKS, keep, words

MIN_WORDS = 15


def _doc() -> Column:
    """A document's key; a struct, so a null doc_id is equal to itself and first in order."""
    return F.struct("doc_id", F.xxhash64("doc_id", "text").alias("text_hash"))


def _place(i: str) -> Column:
    return F.struct("doc", F.col(i).alias("i"))


def _first_places(rows: DataFrame, content: list[str]) -> DataFrame:
    """rows whose content occurs more than once, with `first`: the first place that has it."""
    first = rows.groupBy(*content).agg(F.min(_place("i")).alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    return rows.join(first, content)


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies of shortest runs: doc, i, m (lines of the sequence of worded lines), first (place of the first copy)."""
    one = docs.select(_doc().alias("doc"), F.split("text", "\n", -1).alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("line"), F.size(words(x)).alias("n"), F.unhex(F.md5(x)).alias("id")))
    lines = one.select("doc", F.posexplode(F.filter(numbered, lambda x: x["n"] > 0)).alias("i", "x")).select(
        "doc", "i", "x.line", "x.n", "x.id")
    lines = keep(lines, "lines")  # read twice below: counted, and joined to the counts
    level = keep(_first_places(lines, ["id"]).drop("id").distinct(), "line-ranks")  # equal rows become one
    # stretches of consecutive repeated lines, words before each, and the place after the last
    of_doc = W.partitionBy("doc").orderBy("i")
    stretch = level.select("doc", "i", "n", (F.col("i") - F.row_number().over(of_doc)).alias("stretch"))
    of_stretch = W.partitionBy("doc", "stretch")
    before = F.sum("n").over(of_stretch.orderBy("i")) - F.col("n")
    edges = stretch.withColumn("x", before.cast("long")).withColumn("last", F.max("i").over(of_stretch))
    edges = edges.select("doc", "stretch", F.explode(F.when(F.col("i") == F.col("last"), F.array(
        F.struct("i", "x"), F.struct((F.col("i") + 1).alias("i"), (F.col("x") + F.col("n")).alias("x")))).otherwise(F.array(F.struct("i", "x")))).alias("e")
    ).select("doc", "stretch", "e.i", "e.x")
    by_words = of_stretch.orderBy("x")
    edges = edges.withColumn("to", F.min("i").over(by_words.rangeBetween(min_words, W.unboundedFollowing))).withColumn(
        "since", F.max("i").over(by_words.rangeBetween(W.unboundedPreceding, -min_words)))
    runs = edges.select("doc", F.explode(F.array(
        F.when(F.col("to").isNotNull(), F.struct("i", (F.col("to") - F.col("i")).alias("m"))),
        F.when(F.col("since").isNotNull(), F.struct(F.col("since").alias("i"), (F.col("i") - F.col("since")).alias("m"))))).alias("r")
    ).filter("r IS NOT NULL").select("doc", "r.i", "r.m").distinct()
    runs = keep(runs, "line-windows")
    ranks = level.select("doc", "i", F.col("first").alias("rank"))
    found, length = [], 1
    while True:
        mine = runs.filter((F.col("m") >= length) & (F.col("m") < 2 * length))
        head = mine.join(ranks.withColumnRenamed("rank", "head"), ["doc", "i"])
        tail = ranks.select("doc", F.col("i").alias("j"), F.col("rank").alias("tail"))
        both = head.withColumn("j", F.col("i") + F.col("m") - length).join(tail, ["doc", "j"])
        found.append(_first_places(both, ["m", "head", "tail"]).filter(F.col("first") < _place("i")).select("doc", "i", "m", "first"))
        if 2 * length > min_words:
            break
        ahead = ranks.select("doc", (F.col("i") - length).alias("i"), F.col("rank").alias("second"))
        pairs = ranks.withColumnRenamed("rank", "head").join(ahead, ["doc", "i"])
        ranks = keep(_first_places(pairs, ["head", "second"]).select("doc", "i", F.col("first").alias("rank")), "line-ranks")
        length *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal runs to delete: doc, first_line and last_line (from 0, among the lines with words), source_doc_id, source_line."""
    of_doc = W.partitionBy("doc").orderBy("i", F.desc("m"))
    spans = repeated_windows(docs, min_words).withColumn("reach", F.max(F.col("i") + F.col("m")).over(of_doc.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("i") > F.coalesce("reach", F.lit(-1)), 1).otherwise(0)).over(of_doc))
    return spans.groupBy("doc", "run").agg(
        F.min("i").alias("first_line"), F.max(F.col("i") + F.col("m") - 1).alias("last_line"),
        F.min(F.struct("i", F.col("first.doc.doc_id").alias("doc"), F.col("first.i").alias("line"))).alias("source")
    ).select("doc", "first_line", "last_line", F.col("source.doc").alias("source_doc_id"), F.col("source.line").alias("source_line"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their texts less the later copies, and n_lines (with words) and n_removed."""
    spans = repeated_runs(docs, min_words).groupBy(F.col("doc").alias("r_doc")).agg(
        F.sort_array(F.collect_list(F.struct("first_line", "last_line"))).alias("r_spans"))
    joined = docs.withColumn("r_own", _doc()).join(spans, F.col("r_own") == F.col("r_doc"), "left")
    parts = F.split("text", "\n", -1)
    worded = F.transform(parts, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    # the number of a line among those with words, for documents that lose some
    places = F.filter(F.transform(worded, lambda w, i: F.when(w, i).otherwise(-1)), lambda i: i >= 0)
    gone = F.flatten(F.transform("r_spans", lambda s: F.transform(F.slice(F.col("r_places"), s["first_line"] + 1, s["last_line"] - s["first_line"] + 1), lambda x: x)))
    marked = joined.withColumn("r_places", F.when(F.col("r_spans").isNotNull(), places))
    marked = marked.withColumn("r_gone", F.when(F.col("r_spans").isNotNull(), gone))
    left = F.array_join(F.array_except(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                                       F.transform("r_gone", lambda i: F.struct(i.alias("i"), F.get(parts, i).alias("x"))))["x"], "\n")
    n_lines = F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(BLANKS)) != "")).cast("long")
    return marked.select(
        *[c for c in docs.columns if c not in ("text", "n_lines", "n_removed")], F.when(F.col("r_gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("r_gone"), F.lit(0)).cast("long").alias("n_removed"))
