"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is its set of distinct shingles of `width` words after lower-casing A-Z (fewer words: the whole sequence; none: empty,
linked with nothing). Two documents link when 100 * intersection >= percent * union.

1. Document frequencies of all shingles (packed.py). A document with fewer than ceil(percent * n) shingles that occur
   elsewhere can link with nothing and is done.
2. Equal sets become one representative, the least doc_id.
3. Shingles are ordered by frequency. Two linked sets share one of their n - T + 1 rarest shingles, T = ceil(percent * n); stars
   around the least document of each such inverted list give coarse groups that no link leaves.
4. Coarse groups are cut into blocks by set size; block pairs whose sizes can link are searched, each in one task of bounded
   size. A query merges its short inverted lists, keeps what occurs T - L times there, and probes its L longest lists. Sets that are
   connected already are not compared again, so a family of copies costs links in proportion to its members.
5. Components of the links, alternating stars.

A null doc_id is linked with nothing and gets a null component. Rows that repeat a doc_id keep their own n_shingles and set;
where such sets represent copies, their links are taken together. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlift.llm.common import keep
from ledgerlift.llm.components import components
from ledgerlift.llm.packed import Batch, buckets_for, distinct_sorted, exchange, gram_hashes, pack, with_totals

SETS = "doc_id long, n_shingles long, signature string, terms binary, rare array<bigint>"
BLOCK_TERMS = 3_000_000  # shingles of the sets that one task searches, about
BATCH_WORDS = 1_000_000
BUCKET_ENTRIES = 2_000_000
MU = 0.01                # DivideSkip's weight of probing against merging


def shingle_sets(batch: Batch, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each document, sorted."""
    full = gram_hashes(batch.hashes, width)
    out = []
    for at, n in zip(batch.starts.tolist(), batch.lens.tolist()):
        if n >= width:
            values = np.sort(full[at:at + n - width + 1])
            out.append(values[np.concatenate(([True], values[1:] != values[:-1]))])
        else:
            out.append(gram_hashes(batch.hashes[at:at + n], n) if n else np.zeros(0, np.uint64))
    return out


def needed(n: int, percent: int) -> int:
    """The overlap that a set of n shingles needs with any partner."""
    return -(-percent * n // 100)


def described(batch: Batch, totals: np.ndarray, width: int, percent: int) -> pa.Table:
    sets = shingle_sets(batch, width)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    known = distinct_sorted(every)[0]
    frequency = totals[np.searchsorted(known, every)]
    signature, terms, rare, done = [], [], [], 0
    for s in sets:
        f = frequency[done:done + len(s)]
        done += len(s)
        t = needed(len(s), percent)
        if not len(s) or np.count_nonzero(f > 1) < t:
            signature.append(None)
            terms.append(None)
            rare.append(None)
            continue
        order = np.lexsort((s, f))
        few = order[:len(s) - t + 1]
        signature.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
        terms.append(s[order].tobytes())
        rare.append(s[few[f[few] > 1]].view(np.int64))
    return pa.table({
        "doc_id": pa.array(batch.docs, pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
        "signature": pa.array(signature, pa.string()), "terms": pa.array(terms, pa.binary()), "rare": pa.array(rare, pa.list_(pa.int64()))})


class Forest:
    """Union-find over the sets of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def search(sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets (terms by rising frequency) wherever some pair of them links; if both sides 0 and 1 occur, only pairs
    of different sides are compared. DivideSkip: index lists hold the sets in order of size."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    sizes = np.array([len(sets[i]) for i in order])
    sides = np.array([side[i] for i in order])
    cross = len(set(side)) > 1
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    by_term = np.argsort(flat, kind="stable")  # within a list: by size
    listed, holders = flat[by_term], owner[by_term]
    names, begin = np.unique(listed, return_index=True)
    end = np.append(begin[1:], len(listed))
    place = np.searchsorted(names, flat)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ranked = [np.sort(sets[i]) for i in order]
    forest, links = Forest(len(order)), []
    for q in range(len(order)):
        n = int(sizes[q])
        t = needed(n, percent)
        mine = place[starts[q]:starts[q + 1]]
        low = np.searchsorted(sizes[:q], t)  # smaller sets cannot reach the overlap
        if low == q:
            continue
        lengths = end[mine] - begin[mine]
        longest = int(lengths.max())
        n_long = max(0, min(t - 1, int(t / (MU * math.log2(longest + 1) + 1))))
        by_length = np.argsort(lengths, kind="stable")
        short, long = mine[by_length[:n - n_long]], mine[by_length[n - n_long:]]
        met = np.concatenate([holders[begin[x]:end[x]] for x in short.tolist()])
        met = met[(met >= low) & (met < q)]
        if cross:
            met = met[sides[met] != sides[q]]
        if not len(met):
            continue
        candidates, seen = np.unique(met, return_counts=True)
        passed = seen >= t - n_long
        probes = np.sort(names[long])
        for c, k in zip(candidates[passed].tolist(), seen[passed].tolist()):
            if forest.root(c) == forest.root(q):
                continue
            theirs = ranked[c]
            spot = np.searchsorted(theirs, probes)
            spot[spot == len(theirs)] = 0
            shared = k + int(np.count_nonzero(theirs[spot] == probes))
            if 100 * shared >= percent * (n + len(theirs) - shared) and forest.join(c, q):
                links.append((order[c], order[q]))
    return links


def search_blocks(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        groups = defaultdict(list)
        for r in rows.to_pylist():
            groups[r["coarse"], r["left"], r["right"]].append(r)
        a, b = [], []
        for key in sorted(groups):
            members = sorted(groups[key], key=lambda r: r["rep"])
            found = search([np.frombuffer(r["terms"], np.uint64) for r in members], [r["side"] for r in members], percent)
            a += [members[i]["rep"] for i, _ in found]
            b += [members[j]["rep"] for _, j in found]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def blocks(members: DataFrame, percent: int, block_terms: int) -> DataFrame:
    """members (rep, coarse, n, terms) dealt to tasks: (task, coarse, left, right, side, rep, terms)."""
    by_size = members.groupBy("coarse", "n").agg(F.count("*").alias("sets"))
    run = W.partitionBy("coarse").orderBy("n")  # one row per size, not per document
    terms = F.col("n") * F.col("sets")
    sized = (by_size.withColumn("below", F.sum(terms).over(run) - terms)
             .withColumn("all", F.sum(terms).over(W.partitionBy("coarse")))
             .withColumn("split", F.ceil(terms / block_terms))
             .withColumn("base", F.floor(F.col("below") / block_terms)))
    sized = keep(sized, "sizes")
    spans = (sized.withColumn("block", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("split") - 1)))
             .groupBy("coarse", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("all").alias("all")))
    left = spans.select("coarse", "all", F.col("block").alias("left"), F.col("most").alias("left_most"))
    right = spans.select("coarse", F.col("block").alias("right"), F.col("least").alias("right_least"))
    # a set of n links with none below percent * n
    pairs = left.join(right, "coarse").filter(F.col("right") >= F.col("left")).filter(F.col("right_least") * percent <= F.col("left_most") * 100)
    ends = pairs.select("coarse", "all", "left", "right", F.explode(F.expr(
        "CASE WHEN left = right THEN array(struct(left AS block, 0 AS side)) ELSE array(struct(left AS block, 0 AS side), struct(right AS block, 1 AS side)) END")).alias("e"))
    ends = ends.select("coarse", "all", "left", "right", "e.block", "e.side")
    placed = members.join(sized.select("coarse", "n", "base", "split"), ["coarse", "n"]).withColumn(
        "block", F.col("base") + F.pmod(F.xxhash64("rep"), F.col("split")))
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    packs = max(1, total // block_terms * 2)  # small groups share a task
    small = F.col("all") < block_terms // 4
    task = F.when(small, F.concat(F.lit("p"), F.pmod(F.xxhash64("coarse"), F.lit(packs)))).otherwise(F.concat_ws("-", "coarse", "left", "right"))
    return placed.join(ends, ["coarse", "block"]).select(task.alias("task"), "coarse", "left", "right", "side", "rep", "terms")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    batches = pack(docs, fold_ascii=True, batch_words=BATCH_WORDS)
    _, n_buckets = buckets_for(batches, 1, BUCKET_ENTRIES)

    def asked(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        sets = shingle_sets(batch, width)
        return distinct_sorted(np.concatenate(sets) if sets else np.zeros(0, np.uint64))

    answers = exchange(batches, asked, n_buckets)
    sets = keep(with_totals(batches, answers, lambda b, t: described(b, t, width, percent), SETS), "sets")
    near = sets.filter(F.col("signature").isNotNull() & F.col("doc_id").isNotNull())
    reps = keep(near.groupBy("signature").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("terms").alias("terms"),
                                              F.first("rare").alias("rare")), "representatives")
    postings = reps.select("rep", F.explode("rare").alias("shingle"))
    lists = postings.groupBy("shingle").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    stars = postings.join(lists, "shingle").select(F.col("rep").alias("a"), F.col("least").alias("b")).filter("a <> b")
    coarse = components(stars)
    # a repeated doc_id can represent two sets; both stay members
    members = keep(reps.select("rep", "n", "terms").join(coarse.withColumnRenamed("node", "rep").withColumnRenamed("component", "coarse"), "rep"), "members")
    links = blocks(members, percent, block_terms).groupBy("task").applyInArrow(search_blocks(percent), "a long, b long")
    # the copies of a set join its representative when the rows are put together, not as edges: there may be very many
    found = components(links).withColumnRenamed("node", "rep").withColumnRenamed("component", "least")
    named = reps.select("signature", "rep").join(found, "rep", "left").select("signature", F.coalesce("least", "rep").alias("component_id"))
    linked = near.join(named, "signature").select("doc_id", "n_shingles", "component_id")
    alone = sets.filter(F.col("signature").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
