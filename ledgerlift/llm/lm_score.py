"""Stupid-backoff language-model scores: n-gram count tables partitioned by hash, joined to the documents' n-grams.

The model is the corpus itself without the scored document: each count is the corpus count less the document's own. A word is
scored by the longest n-gram (3, 2, 1 words) that another document holds: count of the n-gram over count of its context,
times 0.4 for each order given up. A word that no other document holds counts one half; the base is the number of all other
words plus one.

Null or empty texts have no words and a score of 0. Each row is a document of its own, also when a doc_id repeats or is null.
Further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlift.llm.packed import Batch, buckets_for, distinct_sorted, exchange, gram_hashes, pack, with_totals

BACKOFF = 0.4
ORDERS = (1, 2, 3)
UNSEEN = 0.5
PIECE_WORDS = 250_000  # scored at a time
SCORES = "doc_id long, n_words long, n_backoff long, n_unseen long, log_score double"


def grams(batch: Batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the positions whose window stays inside its document, and the windows' hashes."""
    room = batch.room
    out = []
    for n in ORDERS:
        hashes = gram_hashes(batch.hashes, n)
        at = np.flatnonzero(room[:len(hashes)] >= n)
        out.append((at, hashes[at]))
    return out


def asked(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    return distinct_sorted(np.concatenate([g for _, g in grams(batch)]))


def looked_up(known: np.ndarray, totals: np.ndarray, keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)  # searching in order stays in the cache
    out = np.empty(len(keys), np.int64)
    out[order] = totals[np.searchsorted(known, keys[order])]
    return out


def occurrences(keys: np.ndarray) -> np.ndarray:
    """For each key, how often it occurs among the keys."""
    known, counts = distinct_sorted(keys)
    return looked_up(known, counts, keys) if len(keys) else np.zeros(0, np.int64)


def scored(batch: Batch, totals: np.ndarray, all_words: int) -> pa.Table:
    known = asked(batch)[0]
    parts, at, starts = [], 0, batch.starts
    while at < len(batch.lens):  # some documents at a time, to bound memory
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE_WORDS)))
        words = batch.hashes[starts[at]:starts[to - 1] + batch.lens[to - 1]]
        parts.append(_scored(Batch(batch.name, batch.docs[at:to], batch.lens[at:to], words), known, totals, all_words))
        at = to
    return pa.concat_tables(parts)


def _scored(batch: Batch, known: np.ndarray, totals: np.ndarray, all_words: int) -> pa.Table:
    lens, n = batch.lens, len(batch.hashes)
    doc = np.repeat(np.arange(len(lens)), lens)
    offset = np.arange(n) - np.repeat(batch.starts, lens)
    counts = []  # in other documents, of the n-gram from each position
    for at, g in grams(batch):
        own = occurrences(g ^ (doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        full = np.zeros(n, np.int64)
        full[at] = looked_up(known, totals, g) - own
        counts.append(full)
    one, two, three = counts

    def before(a: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate((np.zeros(min(k, len(a)), a.dtype), a[:max(0, len(a) - k)]))

    rest = all_words - np.repeat(lens, lens)
    use3 = (offset >= 2) & (before(three, 2) > 0)
    use2 = ~use3 & (offset >= 1) & (before(two, 1) > 0)
    use1 = ~use3 & ~use2
    top = np.where(use3, before(three, 2), np.where(use2, before(two, 1), np.maximum(one, UNSEEN)))
    base = np.where(use3, before(two, 2), np.where(use2, before(one, 1), rest + 1))
    given_up = np.where(use3, 0, np.where(use2, offset >= 2, np.minimum(offset, 2)))
    logs = np.log(top) - np.log(np.maximum(base, 1)) + given_up * np.log(BACKOFF)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=len(lens)).astype(float)

    return pa.table({
        "doc_id": pa.array(batch.docs, pa.int64()), "n_words": lens, "n_backoff": per_doc(given_up > 0).astype(np.int64),
        "n_unseen": per_doc(use1 & (one <= 0)).astype(np.int64), "log_score": per_doc(logs)})


def backoff_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, words scored below their highest order, unseen words, sum of log scores."""
    batches = pack(docs, fold_ascii=False)
    total, n_buckets = buckets_for(batches, len(ORDERS))
    answers = exchange(batches, asked, n_buckets)
    return with_totals(batches, answers, lambda b, t: scored(b, t, total), SCORES)
