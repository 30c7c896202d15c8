"""Repeated passages by relative Lempel-Ziv parsing against an index of the whole corpus; later copies are removed.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A place is (doc_id, word); a window is 20 consecutive words of one document, and a word
goes if a window over it stands at an earlier place too. Windows are judged on the input.

The reference is the corpus itself. Of every 10 consecutive 11-grams of a document the one with the least hash is a seed, so each window
has one and equal windows have equal ones. The reference index maps each seed that occurs twice or more to its first place; its blocks are
hash partitions, and a document asks every block that can hold one of its seeds (a join by hash). A document is then parsed greedily
from left to right: a factor runs on while the next seed's place in the reference lies as far ahead as in the document. Seeds of a
factor overlap or touch, since two neighbours are at most 10 words apart and 11 long, so all its words are compared. A factor of 20 words
or more that is not its own source is a duplicate span.

A window across a factor's boundary may be repeated without lying in one factor. So windows that are in no such span but whose seed
occurs elsewhere are checked themselves: grouped by hash, those after the first place are repeated, too. The first place of any
repeated window is never inside a span (there is nothing before it to copy from), so it is among the checked ones and no copy is
missed. Long copies cost rows for their boundaries only.

Counts and least places are combined before the shuffle, so a very common seed or window is one row per task; a document has a seed or
window once in a join, and joins are split by adaptive execution where a key is hot. Documents are kept in buckets by row, so their texts are not shuffled. Words, seeds and windows
are compared by 64-bit hashes (about n^2 / 2^65 expected collisions of n seeds).

Null texts have no words. Places of a null doc_id come first. Rows that repeat a doc_id are places of one document: of equal rows none
is earlier, so they come out alike. Documents of fewer than 20 words stay as they are. An empty table gives no rows. Columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep, keep_bucketed, on_workers
from ledgerlift.llm.packed import gram_hashes, text_words

WINDOW = 20
SEED = 11                # words of a seed
AMONG = WINDOW - SEED + 1  # consecutive seed places of which one is chosen: all that a window has
SLICE_WORDS = 500_000    # words hashed at once, about; a longer document is a slice of its own
NONE = np.uint64(2**64 - 1)
LEAST = -2**63           # stands for a null doc_id
SEEDS = "h long, row long, doc long, pos int, n int"
MARKS = "row long, doc long, spans array<struct<first:int,last:int>>, windows array<bigint>, places array<int>"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def sliding(values: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """Least or greatest of each `width` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = better(out[:-step], out[step:])
        have += step
    return out


class Hashed:
    """Words of some documents one after the other: hashes of the seeds at each place and of the best seed of each window."""

    def __init__(self, texts: pa.Array):
        self.lens, coded = text_words(texts, False)
        vocabulary = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.words = vocabulary[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
        self.starts = np.concatenate(([0], np.cumsum(self.lens))).astype(np.int64)
        n = len(self.words)
        self.seeds, self.best, self.chosen = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool))
        if n < WINDOW:
            return
        self.seeds = np.minimum(gram_hashes(self.words, SEED), NONE - np.uint64(1))
        self.best = sliding(self.seeds, AMONG, np.minimum)
        room = np.repeat(self.starts[1:], self.lens) - np.arange(n)
        self.best[room[:len(self.best)] < WINDOW] = NONE  # windows that leave their document
        held = np.concatenate((np.full(AMONG - 1, NONE), self.best, np.full(AMONG - 1, NONE)))
        self.chosen = sliding(np.where(held == NONE, 0, held), AMONG, np.maximum) == self.seeds

    def part(self, k: int) -> slice:
        return slice(int(self.starts[k]), int(self.starts[k + 1]))


def slices(rb: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about SLICE_WORDS words (a word has six bytes or more, about)."""
    sizes = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(rb.column(text)).to_pylist()]) // (6 * SLICE_WORDS)
    cut = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), rb.num_rows]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield rb.slice(a, b - a)


def factored(pos: np.ndarray, ref_doc: np.ndarray, ref_pos: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of 20 words or more with an earlier source: first words and the words after the last.

    pos ascends; ref_doc and ref_pos say where the seed at each pos first occurs.
    """
    goes_on = (ref_doc[1:] == ref_doc[:-1]) & (np.diff(ref_pos) == np.diff(pos)) & (np.diff(pos) <= SEED)
    head = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    tail = np.append(head[1:], len(pos)) - 1
    first, after = pos[head], pos[tail] + SEED
    long = (after - first >= WINDOW) & ((ref_doc[head] < doc) | ((ref_doc[head] == doc) & (ref_pos[head] < first)))
    return first[long], after[long]


def parse(hashed: Hashed, k: int, doc: int, known: np.ndarray, ref_doc: np.ndarray, ref_pos: np.ndarray):
    """Spans of document k, and the windows to be checked, each once: hashes and first places. known: sorted hashes of its repeated seeds."""
    own = hashed.part(k)
    n = own.stop - own.start
    seeds = hashed.seeds[own.start:own.stop - SEED + 1]
    chosen = np.flatnonzero(hashed.chosen[own.start:own.stop - SEED + 1])
    at = np.minimum(np.searchsorted(known, seeds[chosen]), len(known) - 1)
    hit = known[at] == seeds[chosen]
    pos, at = chosen[hit], at[hit]
    first, after = factored(pos, ref_doc[at], ref_pos[at], doc)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, after - WINDOW + 1, -1)
    inside = np.cumsum(edges)[:n - WINDOW + 1] > 0
    repeated = np.full(len(seeds), NONE)
    repeated[pos] = seeds[pos]
    best = hashed.best[own.start:own.stop - WINDOW + 1]
    places = np.flatnonzero((sliding(repeated, AMONG, np.minimum) == best) & ~inside)
    windows, at = np.unique(gram_hashes(hashed.words[own], WINDOW)[places], return_index=True)
    again = np.delete(places, at)  # of windows that this document has several times all but the first are copies
    return np.concatenate((first, again)), np.concatenate((after, again + WINDOW)), windows, places[at]


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def seeds(rows: DataFrame) -> DataFrame:
    """Each document's seeds: h, row, doc, the first pos and how many it has."""
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tables:
            for part in slices(rb, 2):
                hashed = Hashed(part.column(2))
                at = np.flatnonzero(hashed.chosen)
                of = np.repeat(np.arange(part.num_rows), hashed.lens)[at]
                pos, h = at - hashed.starts[of], hashed.seeds[at]
                order = np.lexsort((pos, h, of))
                of, pos, h = of[order], pos[order], h[order]
                head = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])))[:len(h)])
                yield pa.RecordBatch.from_pydict({
                    "h": h[head].view(np.int64), "row": part.column(0).take(pa.array(of[head])), "doc": part.column(1).take(pa.array(of[head])),
                    "pos": pos[head].astype(np.int32), "n": np.diff(np.append(head, len(h))).astype(np.int32)})

    return rows.mapInArrow(run, SEEDS)


def index(rows: DataFrame) -> DataFrame:
    """The reference: seeds that occur twice or more, and their first place."""
    grouped = seeds(rows).groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("first"), F.sum("n").alias("n"))
    return keep(grouped.filter("n > 1").select("h", "first"), "reference")  # as a table, so that adaptive execution can split the join


def parsed(rows: DataFrame) -> DataFrame:
    """Spans, and the windows to be checked, of documents with a repeated seed."""
    hits = seeds(rows).select("h", "row").join(index(rows), "h").groupBy("row").agg(F.collect_list(F.struct("h", "first.doc", "first.pos")).alias("known"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tables:
            for part in slices(rb, 2):
                hashed = Hashed(part.column(2))
                known = part.column(3)
                flat, ends = known.flatten(), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(known).to_numpy(zero_copy_only=False))))
                h, ref_doc, ref_pos = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                out = []
                for k, doc in enumerate(part.column(1).to_pylist()):
                    mine = slice(int(ends[k]), int(ends[k + 1]))
                    order = np.argsort(h[mine].view(np.uint64))
                    out.append(parse(hashed, k, doc, h[mine].view(np.uint64)[order], ref_doc[mine][order], ref_pos[mine][order]))
                spans = [len(x[0]) for x in out]
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in out]), pa.int32()) for i in (0, 1)], ["first", "last"])
                yield pa.RecordBatch.from_pydict({
                    "row": part.column(0), "doc": part.column(1), "spans": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *spans]), pa.int32()), pairs),
                    "windows": lists([x[2].view(np.int64) for x in out], pa.int64()), "places": lists([x[3] for x in out], pa.int32())})

    return keep(rows.join(hits, "row").select("row", "doc", "text", "known").mapInArrow(run, MARKS), "factors")


def boundary_windows(marks: DataFrame) -> DataFrame:
    """Per row, the places of checked windows that stand earlier, too."""
    each = marks.select("row", "doc", F.explode(F.arrays_zip("windows", "places")).alias("x")).select(
        "row", "doc", F.col("x.windows").alias("h"), F.col("x.places").alias("pos"))
    place = F.struct("doc", "pos")
    first = each.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("h", "first")
    first = keep(first, "windows")
    return each.join(first, "h").filter(place > F.col("first")).groupBy("row").agg(F.collect_list("pos").alias("later"))


def without_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words left, joined by one space) of every row."""
    on_workers(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rows = keep_bucketed(docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(doc_id, F.lit(LEAST)).alias("doc"),
                                     F.col("text").cast("string").alias("text"), doc_id.alias("doc_id")), "texts", "row")
    marks = parsed(rows.select("row", "doc", "text"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tables:
            out = {"n_words": [], "n_removed": [], "kept_sha256": []}
            for text, spans, later in zip(*(rb.column(c).to_pylist() for c in (1, 2, 3))):
                words = (text or "").encode().split()
                edges = np.zeros(len(words) + 1, np.int64)
                for first, last in [(s["first"], s["last"]) for s in spans or []] + [(p, p + WINDOW) for p in later or []]:
                    edges[first] += 1
                    edges[last] -= 1
                gone = np.cumsum(edges)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": rb.column(0), "n_words": pa.array(out["n_words"], pa.int64()),
                                              "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})

    every = rows.join(marks.select("row", "spans"), "row", "left").join(boundary_windows(marks), "row", "left")
    return every.select("doc_id", "text", "spans", "later").mapInArrow(run, RESULT)
