"""Alignment of two tokenizers' tokens by diagonal run skipping, and corpus-wide counts of the id pairs they link.

A text is encoded twice: by a byte-level BPE (A, over a space and the text) and by a sentencepiece model (B, which adds the space). Each
token has its bytes, so a text has two rising arrays of end offsets over the same bytes; where both have an end, a group closes.

`align` walks the arrays at an index shift (where B stands less where A stands). While tokens are one to one, slices of both arrays at
that shift are equal: they are compared in steps of 1, 2, 4, ..., halved again where they differ, so a stretch of any length is jumped in
logarithmically many comparisons. What is left is an irregular group: the smaller end advances until both meet, and the shift is updated.

No token is without bytes, so each offset holds at most one end of either side: a group has one link, its last tokens. Pairs are counted
over all documents by a grouped sum, combined before the shuffle; documents join the counts by pair, as rows. Counts are broadcast up
to BROADCAST_PAIRS rows (counted first), beyond that the join is a shuffle; both give the same rows.

Encoding is remembered per unit: a text is cut at single spaces between two characters that are no white space. There a new piece of A's
split pattern starts, and no piece of B has a space behind other characters (checked when the tables are made), so a unit's tokens do not
depend on its neighbours.

Null and empty texts, and texts whose joined token bytes differ from space and text, have no tokens: zeros, and '' for the groups.
Rows that repeat a doc_id, null or not, are documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlift.llm.common import keep, on_workers

KEPT_TOKENS = 3_000_000     # of remembered units; beyond, a worker starts anew
SLICE_DOCS = 200            # documents whose tokens are laid out at once
BROADCAST_PAIRS = 1_000_000
FIELDS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def align(ends_a: list, ends_b: list) -> tuple[list, list, list]:
    """The irregular groups of two rising lists with the same last element, in between all is one to one.

    Per irregular group: index of its first token of A, and how many tokens of either side it has.
    """
    i = j = 0
    n = len(ends_a)
    first, size_a, size_b = [], [], []
    while i < n:
        if ends_a[i] == ends_b[j]:  # a one-to-one stretch at the shift j - i
            i, j = i + 1, j + 1
            step = 1
            while i < n and ends_a[i:i + step] == ends_b[j:j + step]:
                i, j = i + step, j + step
                step *= 2
            while step > 1 and i < n:
                step //= 2
                if ends_a[i:i + step] == ends_b[j:j + step]:
                    i, j = i + step, j + step
        else:  # an irregular group; the shift changes if its sides differ in length
            p, q = i, j
            x, y = ends_a[i], ends_b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = ends_a[i]
                else:
                    j += 1
                    y = ends_b[j]
            i, j = i + 1, j + 1
            first.append(p)
            size_a.append(i - p)
            size_b.append(j - q)
    return first, size_a, size_b


def group_sizes(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group."""
    first, size_a, size_b = (np.array(x, np.int64) for x in align(ends_a.tolist(), ends_b.tolist()))
    place = first - np.cumsum(size_a) + size_a + np.arange(len(first))  # of the irregular groups among all
    n = len(ends_a) - int(size_a.sum()) + len(first)
    of_a, of_b = np.ones(n, np.int64), np.ones(n, np.int64)
    of_a[place], of_b[place] = size_a, size_b
    return of_a, of_b


class Side:
    """A tokenizer's ids as bytes, their lengths, and their decimals followed by a separator inside and at the end of a group."""

    def __init__(self, tokens: list[bytes], end: str):
        self.tokens = tokens
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.words = [x for k in range(len(tokens)) for x in (f"{k},", f"{k}{end}")]
        self.width = len(self.words)


def _byte_level() -> dict[str, int]:
    """Characters of byte-level entries: visible bytes stand for themselves, the others follow from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers and the tokens of units seen so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.lib_a = Tokenizer.from_file(path_a)
        self.lib_a.encode_special_tokens = True
        self.lib_a.no_truncation()
        self.lib_a.no_padding()
        self.lib_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = _byte_level()
        entries = [self.lib_a.id_to_token(k) or "" for k in range(self.lib_a.get_vocab_size())]
        pieces = [self.lib_b.id_to_piece(k) for k in range(self.lib_b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path_b} has pieces with a space behind other characters")
        self.a = Side([bytes(chars[c] for c in e) if all(c in chars for c in e) else e.encode() for e in entries], "|")
        self.b = Side([bytes([int(p[3:5], 16)]) if self.lib_b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)], ";")
        self.words = np.array(self.a.words + self.b.words, object)
        self.forget()

    def forget(self) -> None:
        """Remembered units: a number each; per side the ids of all, where each unit's begin, and its length; whether both sides give back
        its bytes; whether it is no whole unit in a text cut at every space."""
        self.seen: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.sizes = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.same, self.loose = np.zeros(0, bool), np.zeros(0, bool)

    def codes(self, units: list[str]) -> np.ndarray:
        """Numbers of units, encoding what is not remembered."""
        new = [u for u in dict.fromkeys(units) if u not in self.seen]
        if len(self.ids[0]) > KEPT_TOKENS:
            self.forget()
            new = list(dict.fromkeys(units))
        ids: tuple[list, list] = ([self.ids[0]], [self.ids[1]])
        sizes: tuple[list, list] = ([], [])
        same = []
        for at in range(0, len(new), 2000):
            part = new[at:at + 2000]
            in_a = [e.ids for e in self.lib_a.encode_batch_fast([f" {u}" for u in part], add_special_tokens=False)]
            in_b = self.lib_b.encode(part, num_threads=1)
            for side, lists_of in enumerate((in_a, in_b)):
                sizes[side].extend(map(len, lists_of))
                ids[side].append(np.fromiter(chain.from_iterable(lists_of), np.int32))
            same += [b"".join(map(self.a.tokens.__getitem__, a)) == f" {u}".encode() == b"".join(map(self.b.tokens.__getitem__, b))
                     for u, a, b in zip(part, in_a, in_b)]
        if new:
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
            self.ids = [np.concatenate(x) for x in ids]
            self.sizes = [np.concatenate((x, np.array(y, np.int64))) for x, y in zip(self.sizes, sizes)]
            self.starts = [np.cumsum(x) - x for x in self.sizes]
            self.same = np.concatenate((self.same, np.array(same, bool)))
            self.loose = np.concatenate((self.loose, np.array([not u or u[0].isspace() or u[-1].isspace() for u in new], bool)))
        return np.fromiter(map(self.seen.__getitem__, units), np.int64, len(units))

    def tokens(self, codes: np.ndarray, side: int) -> np.ndarray:
        """Ids of consecutive units."""
        sizes = self.sizes[side][codes]
        shift = self.starts[side][codes] - (np.cumsum(sizes) - sizes)
        return self.ids[side][np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]

    def documents(self, texts: list[str | None]) -> list[dict]:
        units = [t.split(" ") if t else [] for t in texts]
        codes = self.codes(list(chain.from_iterable(units)))
        cut = np.split(codes, np.cumsum([len(u) for u in units])[:-1])
        loose = [k for k, c in enumerate(cut) if self.loose[c].any()]
        out = [self.document(c) for c in cut if c is not None]
        for k in loose:  # spaces beside other white space stay inside a unit
            out[k] = self.document(self.codes(_CUT.split(texts[k])))
        return out

    def document(self, codes: np.ndarray) -> dict:
        """The aligned document of these units; nothing if its tokens do not give back its bytes."""
        if not len(codes) or not self.same[codes].all():
            return NOTHING
        a, b = self.tokens(codes, 0), self.tokens(codes, 1)
        of_a, of_b = group_sizes(np.cumsum(self.a.lens[a]), np.cumsum(self.b.lens[b]))
        after_a, after_b = np.cumsum(of_a), np.cumsum(of_b)
        pairs, times = np.unique(a[after_a - 1].astype(np.int64) << 32 | b[after_b - 1], return_counts=True)
        # decimals with separators: a group's A tokens, then its B tokens
        code_a, code_b = 2 * a, 2 * b + self.a.width
        code_a[after_a - 1] += 1
        code_b[after_b - 1] += 1
        words = np.empty(len(a) + len(b), np.int32)
        words[np.arange(len(a)) + np.repeat(after_b - of_b, of_a)] = code_a
        words[np.arange(len(b)) + np.repeat(after_a, of_b)] = code_b
        digest = hashlib.sha256("".join(self.words[words].tolist())[:-1].encode()).hexdigest()
        return {"n_a": len(a), "n_b": len(b), "n_groups": len(of_a), "n_links": len(of_a), "groups_sha256": digest, "pairs": pairs, "times": times}


@cache
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


NOTHING = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One kept row per document: its numbers, the digest of its groups, and its distinct linked pairs (A id << 32 | B id) with their times."""
    on_workers(docs.sparkSession)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(path_a, path_b)
        for rb in tables:
            for at in range(0, rb.num_rows, SLICE_DOCS):
                part = rb.slice(at, SLICE_DOCS)
                out = both.documents(part.column(2).to_pylist())
                yield pa.RecordBatch.from_pydict({
                    "row": part.column(0), "doc_id": part.column(1),
                    **{c: pa.array([d[c] for d in out], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                    "groups_sha256": [d["groups_sha256"] for d in out],
                    "pairs": lists([d["pairs"] for d in out], pa.int64()), "times": lists([d["times"] for d in out], pa.int32())})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keep(rows.mapInArrow(run, FIELDS), "aligned")


def links(documents: DataFrame) -> DataFrame:
    """row, pair, times of aligned documents."""
    each = documents.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return each.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def pair_counts(documents: DataFrame) -> DataFrame:
    """a, b, n (links corpus-wide that hold the pair) and best: no other pair of this B id has more."""
    pairs = links(documents).groupBy("pair").agg(F.sum("times").alias("n"))
    a, b = F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b")
    of_b = W.partitionBy("b")  # an id has at most as many pairs as A has ids
    return keep(pairs.select("pair", a, b, "n").withColumn("best", F.col("n") == F.max("n").over(of_b)), "pair-counts")


def alignment(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    documents = aligned(docs, path_a, path_b)
    counts = pair_counts(documents).select("pair", "n", "best")
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    sums = links(documents).join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return documents.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256")
