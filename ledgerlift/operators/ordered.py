"""Order-dependent columns over groups of any size.

A plain window over a document puts the whole document in one task. `scan` instead range-partitions the rows by (keys, position),
so each partition holds a like number of consecutive rows whatever gaps the positions have, writes them down with their partition's
number, runs the window inside (group, partition), and carries only one summary row per partition across a group. A document
holding a third of all lines is spread over as many tasks as its rows fill, and a group's carried part is never longer than the
number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.session import released, staged

BLOCK = 65_536
SALTS = 16
BLOCK_NO = "block_no"  # number of a row's block, given by `in_blocks`
KEY_ROWS = "key_rows"  # of facts: how many rows their key has, see `attach`
BROADCAST_ROWS = 10_000  # facts of so many keys are copied to every task; more are never held by the driver


def in_blocks(df: DataFrame, keys: list[str], pos: str = "line_no", tie: str | None = None, parts: int | None = None) -> DataFrame:
    """Rows in partitions of consecutive rows, with the partition's number as BLOCK_NO. Later scans of these rows or of some of them,
    in the same order, need no partitioning of their own. The rows are computed twice, once for the bounds, so they should be narrow and written."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, pos, *([tie] if tie else [])).withColumn(BLOCK_NO, F.spark_partition_id())


def scan(df: DataFrame, keys: list[str], pos: str = "line_no", *, fill: dict | None = None,
         next_fill: dict | None = None, sums: dict | None = None, lags: dict | None = None,
         leads: dict | None = None, fill_before: dict | None = None, tie: str | None = None,
         parts: int | None = None, blocks: str | None = None, keep: list[str] | None = None, then=None) -> DataFrame:
    """Add ordered columns.

    fill       out -> column: latest non-null value at or before the row
    fill_before out -> column: latest non-null value strictly before the row
    next_fill  out -> column: next non-null value at or after the row
    sums       out -> column: running sum up to and including the row
    lags       out -> column: value of the row before (null for the first)
    leads      out -> column: value of the row after (null for the last)
    tie        column deciding the order of rows with equal position
    parts      number of range partitions; the session's shuffle partitions if not given
    blocks     column with the number of a row's block of consecutive rows (see `in_blocks`), if the rows are cut into blocks already
    keep       columns that stay beside the keys and the new ones; all if not given
    then       takes the result; what it gives is written, and the rows written before leave

    The input is computed once and written to the shared folder (jobs that run while the plan is built), so scans on top of scans
    do not repeat what is below them.
    """
    fill, next_fill, sums, lags, leads, earlier = (d or {} for d in (fill, next_fill, sums, lags, leads, fill_before))
    carry_on = {**fill, **earlier}
    order = [F.col(pos)] + ([F.col(tie)] if tie else [])
    back = [c.desc() for c in order]
    at = F.struct(*order)
    inputs = {f"_in_{o}": F.col(c) if isinstance(c, str) else c
              for d in (fill, next_fill, sums, lags, leads, earlier) for o, c in d.items()}
    own = df.columns if keep is None else [c for c in df.columns if c in keep or c in keys]
    held = [*own, *[c for c in dict.fromkeys([pos, tie]) if c and c not in own]]
    source = df.select(*held, *[c.alias(o) for o, c in inputs.items()], *([F.col(blocks).alias("_blk")] if blocks else []))
    if blocks is None:
        # written before, too: the range bounds are sampled in a pass of their own, which must not compute the input again
        n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        unordered = staged(source, "scan-input")
        written = staged(unordered.repartitionByRange(n, *keys, *order).withColumn("_blk", F.spark_partition_id()), "scan")
        released(written, unordered)
    else:
        written = staged(source, "scan")
    # as a struct, null keys are equal to each other: windows, sums and the join share one partitioning
    base = written.withColumn("_key", F.struct(*keys)).drop(*[k for k in keys if k not in (pos, tie)])

    fwd = Window.partitionBy("_key", "_blk").orderBy(*order)
    bwd = Window.partitionBy("_key", "_blk").orderBy(*back)
    upto = fwd.rowsBetween(Window.unboundedPreceding, 0)
    # backward fill is a forward running window over the reversed order
    from_here = bwd.rowsBetween(Window.unboundedPreceding, 0)
    inside = {}
    for o in fill:
        inside[f"_w_{o}"] = F.last(f"_in_{o}", ignorenulls=True).over(upto)
    for o in earlier:
        inside[f"_w_{o}"] = F.last(f"_in_{o}", ignorenulls=True).over(fwd.rowsBetween(Window.unboundedPreceding, -1))
    for o in next_fill:
        inside[f"_w_{o}"] = F.last(f"_in_{o}", ignorenulls=True).over(from_here)
    for o in sums:
        inside[f"_w_{o}"] = F.sum(f"_in_{o}").over(upto)
    for o in lags:
        inside[f"_w_{o}"] = F.lag(F.struct(f"_in_{o}")).over(fwd)
    for o in leads:
        inside[f"_w_{o}"] = F.lag(F.struct(f"_in_{o}")).over(bwd)
    local = base.withColumns(inside)

    aggs = []
    for o in carry_on:
        aggs.append(F.max(F.when(F.col(f"_in_{o}").isNotNull(), F.struct(at.alias("p"), F.col(f"_in_{o}").alias("v"))))
                    .alias(f"_s_{o}"))
    for o in next_fill:
        aggs.append(F.min(F.when(F.col(f"_in_{o}").isNotNull(), F.struct(at.alias("p"), F.col(f"_in_{o}").alias("v"))))
                    .alias(f"_s_{o}"))
    for o in sums:
        aggs.append(F.sum(f"_in_{o}").alias(f"_s_{o}"))
    for o in lags:
        aggs.append(F.max(F.struct(at.alias("p"), F.struct(F.col(f"_in_{o}")).alias("v"))).alias(f"_s_{o}"))
    for o in leads:
        aggs.append(F.min(F.struct(at.alias("p"), F.struct(F.col(f"_in_{o}")).alias("v"))).alias(f"_s_{o}"))
    edges = base.groupBy("_key", "_blk").agg(*aggs)
    before = Window.partitionBy("_key").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_key").orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = {}
    for o in carry_on:
        carried[f"_c_{o}"] = F.last(f"_s_{o}", ignorenulls=True).over(before)["v"]
    for o in next_fill:
        carried[f"_c_{o}"] = F.last(f"_s_{o}", ignorenulls=True).over(after)["v"]
    for o in sums:
        carried[f"_c_{o}"] = F.sum(f"_s_{o}").over(before)
    for o in lags:
        carried[f"_c_{o}"] = F.last(f"_s_{o}", ignorenulls=True).over(before)["v"]
    for o in leads:
        carried[f"_c_{o}"] = F.last(f"_s_{o}", ignorenulls=True).over(after)["v"]
    edges = edges.select("_key", "_blk", *[e.alias(n) for n, e in carried.items()])

    # files are compressed, so their size says little about rows: edges of many groups must not become a broadcast
    joined = local.join(edges.hint("merge"), ["_key", "_blk"], "left")
    final = {}
    for o in [*carry_on, *next_fill]:
        final[o] = F.coalesce(f"_w_{o}", f"_c_{o}")
    for o in sums:
        final[o] = F.coalesce(F.col(f"_w_{o}"), F.lit(0)) + F.coalesce(F.col(f"_c_{o}"), F.lit(0))
    for o in [*lags, *leads]:
        final[o] = F.coalesce(f"_w_{o}", f"_c_{o}")[f"_in_{o}"]
    kept = [F.col("_key")[c].alias(c) if c in keys else F.col(f"`{c}`") for c in own if c not in final]
    out = joined.select(*kept, *[e.alias(o) for o, e in final.items()])
    if then is None:
        return out
    done = staged(then(out), "scanned")
    return released(done, written)


def neighbours(df: DataFrame, keys: list[str], pos: str, reach: int, *steps, block: int = BLOCK, numbered: bool = False) -> DataFrame:
    """Columns that look at most `reach` rows ahead or behind, whatever gaps the positions have.

    Rows are numbered first. Rows near a block edge are copied into the neighbouring block, so every block sees all it needs; the
    copies leave at the end. Each step maps a window over (group, block) to new columns. numbered: `pos` counts the rows already.
    """
    at = pos if numbered else "_n"
    rows = df if numbered else number_rows(df, keys, pos, at)
    own = F.floor(F.col(at) / block).cast("bigint")
    near = [F.floor((F.col(at) + d) / block).cast("bigint") for d in (-reach, 0, reach)]
    out = rows.withColumn("_own", own).withColumn("_blk", F.explode(F.array_distinct(F.array(*near))))
    w = Window.partitionBy(*keys, "_blk").orderBy(at)
    for step in steps:
        out = out.withColumns(step(w))
    return out.where(F.col("_blk") == F.col("_own")).drop("_blk", "_own", *([] if numbered else ["_n"]))


def number_rows(df: DataFrame, keys: list[str], pos: str, out: str = "line_no", tie: str | None = None) -> DataFrame:
    """Consecutive numbers from 0 in position order, for groups of any size."""
    return scan(df, keys, pos, sums={out: F.lit(1).cast("bigint")}, tie=tie).withColumn(out, F.col(out) - 1)


def first_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each group. The rank limit is applied before the shuffle, so big groups shrink on the map side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def attach(df: DataFrame, facts: DataFrame, keys: list[str], spread, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join one-row-per-key facts to many rows per key.

    The facts are written down and counted. Up to BROADCAST_ROWS of them are broadcast as they are, and the rows stay where they lie.
    More are joined by a sort that is salted so no key is one task: `spread` is any column that varies inside a key, and the
    facts are repeated `salts` times. These copies are never broadcast, whatever their files' size suggests. If the facts know how many
    rows a key has (KEY_ROWS, which does not come out), only keys of more than BLOCK rows are salted and repeated.
    """
    facts = staged(facts, "facts")
    if facts.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(facts.drop(KEY_ROWS)), keys, how)
    salt = F.pmod(F.xxhash64(spread if isinstance(spread, Column) else F.col(spread)), F.lit(salts)).cast("int")
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    if KEY_ROWS in facts.columns:
        large = F.coalesce(F.col(KEY_ROWS) > BLOCK, F.lit(False))
        keys_of_many = facts.where(large).select(*keys, F.lit(True).alias("_many"))  # one for BLOCK rows at most
        if keys_of_many.isEmpty():
            return df.join(facts.drop(KEY_ROWS).hint("merge"), keys, how)
        salted = df.join(F.broadcast(keys_of_many), keys, "left").withColumn("_salt", F.when(F.col("_many"), salt).otherwise(0)).drop("_many")
        copies = facts.withColumn("_salt", F.explode(F.when(large, all_salts).otherwise(F.array(F.lit(0))))).drop(KEY_ROWS)
    else:
        salted = df.withColumn("_salt", salt)
        copies = facts.withColumn("_salt", F.explode(all_salts))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")
