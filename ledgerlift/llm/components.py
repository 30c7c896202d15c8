"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Every node hands its neighbours (the larger ones, or the smaller ones and itself) to its least one."""
    if large:
        seen = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = seen.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        seen = edges.toDF("u", "v")
        least = seen.groupBy("u").agg(F.min("v").alias("m"))
        out = seen.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (a, b), whole numbers, with the least node it reaches.

    Edges may repeat, point either way or be loops; a node that only has loops is left out. Each round is kept as a table; the
    driver reads one count and checksum per round.
    """
    state = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    mark = None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == mark or now[0] == 0:
            break
        mark = tuple(now)
        state = keep(_star(_star(state, True), False), "stars")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select("b", "b").distinct())
