"""Counts of n-grams over a whole corpus without a row per n-gram.

Documents are packed into batches of words. A batch asks for the counts of its distinct n-grams: one row per hash bucket,
holding sorted 64-bit hashes. A bucket sums what all batches ask for (the count table, partitioned by hash) and answers
each batch in the order of its question, so the answer needs no keys. A frequent n-gram is one entry per batch, whatever
its number of occurrences: no key is hot. Buckets are as many as the number of entries needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep_bucketed, on_workers

BATCH_WORDS = 2_000_000     # a batch closes beyond so many words; one longer document is a batch of its own
BUCKET_ENTRIES = 4_000_000  # entries that a bucket holds in memory, about
BATCHES = "batch string, n_words long, docs array<bigint>, lens binary, vocabulary binary, words binary"
ASKED = "bucket int, batch string, grams binary, counts binary"
ANSWERED = "batch string, bucket int, totals binary"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Batch:
    name: str
    docs: list            # doc_id of each document, may be None
    lens: np.ndarray      # words of each document
    hashes: np.ndarray    # uint64 hash of each word, documents one after the other

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.lens)))[:-1].astype(np.int64)

    @property
    def room(self) -> np.ndarray:
        """Words from each position to the end of its document."""
        ends = np.repeat(self.starts + self.lens, self.lens)
        return ends - np.arange(len(self.hashes))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n words from each position; positions whose window leaves the array are left out."""
    m = max(0, len(hashes) - n + 1)
    out = np.full(m, n, np.uint64) * _B
    for j in range(n):
        out = ((out << np.uint64(23)) | (out >> np.uint64(41))) ^ hashes[j:j + m]
        out *= _A
        out ^= out >> np.uint64(29)
    return out * _B ^ (out >> np.uint64(32))


def distinct_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.diff(np.append(first, len(values)))


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """Byte planes of an array of whole numbers, compressed; of the steps between them if they rise."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    if rising:
        values = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def expand(data: bytes, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(values, dtype=np.uint64) if rising else values


def text_words(texts: pa.Array, fold_ascii: bool) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words [^\\x20\\x09-\\x0D]+ per text, and all words as a dictionary array (its dictionary may repeat words)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    lens = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    lens[pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)] = 0
    flat = pc.list_flatten(parts)
    coded = pc.dictionary_encode(flat.filter(pc.greater(pc.binary_length(flat), 0)))
    if fold_ascii:  # on the distinct words; some then repeat
        coded = pa.DictionaryArray.from_arrays(coded.indices, pc.ascii_lower(coded.dictionary))
    return lens, coded


def pack(docs: DataFrame, fold_ascii: bool, batch_words: int = BATCH_WORDS) -> DataFrame:
    """Batches of documents (doc_id, text) as word hashes, kept in the shared folder."""
    on_workers(docs.sparkSession)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        held: list = []

        def close() -> pa.RecordBatch:
            names: dict[str, int] = {}
            ids, lens, docs_in = [], [], []
            for doc_ids, n, coded in held:
                local = np.fromiter((names.setdefault(w, len(names)) for w in coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary))
                ids.append(local[coded.indices.to_numpy(zero_copy_only=False)])
                lens.append(n)
                docs_in += doc_ids
            vocabulary = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pydict({
                "batch": [f"{part}-{serial}"], "n_words": [len(flat)], "docs": pa.array([docs_in], pa.list_(pa.int64())),
                "lens": [squeeze(np.concatenate(lens))], "vocabulary": [vocabulary.tobytes()], "words": [squeeze(flat)]})

        size = 0
        for rb in tables:
            for at in range(0, rb.num_rows, 500):
                piece = rb.slice(at, 500)
                lens, coded = text_words(piece.column(1), fold_ascii)
                held.append((piece.column(0).to_pylist(), lens, coded))
                size += len(coded)
                if size >= batch_words:
                    yield close()
                    held.clear()
                    serial, size = serial + 1, 0
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keep_bucketed(rows.mapInArrow(run, BATCHES), "batches", "batch")


def load(row: dict) -> Batch:
    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    return Batch(row["batch"], row["docs"], expand(row["lens"]).astype(np.int64), vocabulary[expand(row["words"]).astype(np.int64)])


def buckets_for(batches: DataFrame, per_word: int, bucket_entries: int = BUCKET_ENTRIES) -> tuple[int, int]:
    """The number of words, and how many buckets (a power of two) their n-grams need."""
    total = batches.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    n = 1
    while n * bucket_entries < total * per_word and n < 1 << 30:
        n *= 2
    return total, n


def exchange(batches: DataFrame, entries: Callable[[Batch], tuple[np.ndarray, np.ndarray]], n_buckets: int) -> DataFrame:
    """For the sorted entries of each batch and their counts: the sums over all batches, in answers of one row per bucket."""
    shift = np.uint64(64 - n_buckets.bit_length() + 1) if n_buckets > 1 else None

    def ask(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tables:
            for row in rb.to_pylist():
                grams, counts = entries(load(row))
                edges = [0, len(grams)] if shift is None else [*np.searchsorted(grams >> shift, np.arange(n_buckets, dtype=np.uint64)), len(grams)]
                spans = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
                for at in range(0, len(spans), 64):
                    some = spans[at:at + 64]
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([b for b, _, _ in some], pa.int32()), "batch": [row["batch"]] * len(some),
                        "grams": [squeeze(grams[lo:hi], True) for _, lo, hi in some], "counts": [squeeze(counts[lo:hi]) for _, lo, hi in some]})

    def answer(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        own = [expand(r["grams"], True) for r in rows]
        every = np.concatenate(own)
        counts = np.concatenate([expand(r["counts"]) for r in rows]).astype(np.int64)
        order = np.argsort(every)
        ranked = every[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        sums = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(ranked))))
        totals = np.empty(len(every), np.int64)
        totals[order] = sums
        cut = np.cumsum([len(x) for x in own])[:-1]
        return pa.table({"batch": [r["batch"] for r in rows], "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                         "totals": [squeeze(x) for x in np.split(totals, cut)]})

    return batches.mapInArrow(ask, ASKED).groupBy("bucket").applyInArrow(answer, ANSWERED)


def answered(answers: pa.Table) -> np.ndarray:
    """The sums for a batch's entries, in the entries' order."""
    parts = [expand(r["totals"]) for r in sorted(answers.to_pylist(), key=lambda r: r["bucket"])]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def with_totals(batches: DataFrame, answers: DataFrame, finish: Callable[[Batch, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """finish(batch, sums of its entries) for every batch."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(load(left.to_pylist()[0]), answered(right))

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)
