"""A Merkle manifest of a table: levels as concatenated hex strings, parents by fixed-width substrings.

Every row is a leaf: the SHA-256 of its fields, each written as `-` if null and else as UTF-8 byte count, `:` and value. Per lang, leaves
ascend by doc_id, and every 8 consecutive nodes (the last run may be shorter) become the hash of their concatenated hex digests until one
is left, the subroot. Subroots ordered by lang give the root the same way.

Nodes are numbered by a range partition and cut into aligned blocks of 512. A block is one row that keeps each of its levels as one
hex string: the parent of run i is the hash of the substring of 8 * 64 characters at i, so a block folds three levels without a join.
The roots of blocks are the nodes of the next round, with the block's number as their place; rounds go on until every lang is
one block. On the way back a node's siblings are the two substrings that flank it in its run; its path is its own block's segments
followed by its block's path. `manifest` folds every path from a leaf recomputed over altered text, so a change shows as a
root that differs.

No group is gathered beyond a block; a lang of any size is as many blocks as it needs. The driver reads one number, the most levels.

Null doc_id come first, a null lang is a lang of its own and comes first. Rows that repeat a doc_id are ordered by their leaf; equal rows
are leaves of their own. Null fields are `-`, empty ones `0:`. Rows whose doc_id is null are never altered. An empty table gives no
rows. Columns beyond doc_id, source, lang, n_chars and text are neither hashed nor returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlift.llm.common import keep

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RUN = 8                # nodes that become one parent
HEX = 64               # characters of a node
LEVELS = 3             # levels that a block folds
BLOCK = RUN ** LEVELS  # nodes of a block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[Column]) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as it is hashed."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """grp (the lang), doc_id, node (the leaf) and altered: the leaf over lower-cased text where the doc_id's checksum says so."""
    whole = [field(F.col(c)) for c in FIELDS]
    lowered = digest([*whole[:-1], field(F.translate("text", UPPER, LOWER))])
    tampered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    # a tie of equal rows is cut by their place in this table, so range partitions can part them
    return keep(docs.select(F.struct("lang").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), digest(whole).alias("node"),
                            F.when(tampered, lowered).alias("altered"), F.monotonically_increasing_id().alias("tie")), "leaves")


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add pos (from 0, within grp) and total (nodes of grp), for groups of any size."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.repartitionByRange(n, "grp", *order).sortWithinPartitions("grp", *order)
    placed = keep(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "placed")
    starts = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_grp = W.partitionBy("grp")
    earlier = F.sum("n").over(of_grp.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = starts.select("grp", "part", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(of_grp).alias("total"))
    return placed.join(starts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift", "tie")


def parents(level: Column) -> Column:
    """The next level of a level that has a node or more."""
    runs = F.ceil(F.length(level) / F.lit(RUN * HEX)).cast("int")
    cut = lambda i: F.sha2(F.substr(level, i * RUN * HEX + 1, F.lit(RUN * HEX)), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), cut), "")


def siblings(level: Column, place: Column) -> Column:
    """The segments before and after a node in its run."""
    run = F.floor(place / RUN).cast("int") * RUN
    return F.struct(F.substr(level, run * HEX + 1, (place - run) * HEX).alias("left"),
                    F.substr(level, (place + 1) * HEX + 1, (run + RUN - 1 - place) * HEX).alias("right"))


def climb(nodes: DataFrame, carried: list[str] | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, and one row (grp, node) per grp: its root."""
    powers = F.array(*[F.lit(RUN ** k) for k in range(21)])
    nodes = nodes.withColumn("levels", F.size(F.filter(powers, lambda p: p < F.col("total"))))  # levels until one node is left
    item = F.struct("pos", "node", *(carried or []))
    rounds, left = [], None
    while left is None or left > 0:
        level = [F.col(f"level{k}") for k in range(LEVELS + 1)]
        blocks = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
            F.first("levels").alias("levels"), F.array_sort(F.collect_list(item)).alias("items"))
        blocks = blocks.withColumn("level0", F.array_join("items.node", "")).withColumn("items", F.transform(
            "items", lambda x: x.dropFields("node", "pos") if carried else F.struct((x["pos"] % BLOCK).alias("slot"))))
        for k in range(LEVELS):
            blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("levels") > k, parents(level[k])).otherwise(level[k]))
        blocks = keep(blocks, "blocks")
        if left is None:
            left = blocks.agg(F.coalesce(F.max("levels"), F.lit(0)).alias("n")).first()["n"]
        left -= LEVELS
        rounds.append(blocks)
        nodes = blocks.select("grp", F.col("block").alias("pos"), F.greatest(F.col("levels") - LEVELS, F.lit(0)).alias("levels"), level[LEVELS].alias("node"))
        item, carried = F.struct("pos", "node"), None
    return rounds, nodes.select("grp", "node")


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every node of the first round with its path up to the end of above's path. above: grp, path, and columns to hand down."""
    down = [c for c in above.columns if c not in ("grp", "path")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for k, blocks in reversed(list(enumerate(rounds))):
        own = F.slice(F.array(*[siblings(F.col(f"level{j}"), F.floor(F.col("slot") / RUN ** j).cast("int")) for j in range(LEVELS)]),
                      F.lit(1), F.least(F.col("levels"), F.lit(LEVELS)))
        each = blocks.join(above, ["grp", "block"]).select("*", F.posexplode("items").alias("slot", "item"))
        each = each.select("grp", (F.col("block") * BLOCK + F.col("slot")).alias("pos"), F.concat(own, "path").alias("path"), *down,
                           F.substr("level0", F.col("slot") * HEX + 1, F.lit(HEX)).alias("node"), "item")
        above = each.select("grp", F.col("pos").alias("block"), "path", *down)
        if k:
            above = keep(above, "paths")
    return each


def folded(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda node, s: digest([s["left"], node, s["right"]]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rounds, subroots = climb(numbered(leaves(docs), ["doc_id", "node", "tie"]), ["doc_id", "altered"])
    langs = keep(subroots.select(F.struct(F.lit(0)).alias("grp"), F.col("grp.lang").alias("lang"), "node"), "subroots")
    lang_rounds, root = climb(numbered(langs, ["lang"]), ["lang"])
    top = root.select("grp", F.col("node").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    of_lang = keep(descend(lang_rounds, top).select(F.struct("item.lang").alias("grp"), "path", F.col("node").alias("subroot"), "root"), "lang-paths")
    every = descend(rounds, of_lang)
    segments = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    back = folded(F.coalesce("item.altered", "node"), F.col("path"))
    out = every.select("item.doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(segments, 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
