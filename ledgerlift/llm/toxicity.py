"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and a sample of all texts without regard to labels (U) train linear classifiers in numpy on the
non-negative risk  prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])  with logistic loss; when the corrected part falls below
zero, its gradient is turned. The prior is the share of toxic rows among labelled ones. MEMBERS classifiers each leave out one part of
the sample and train in one task each; a score is the mean of their probabilities.

Features are words (lower case, outer punctuation off) and their beginnings of 4 to 6 characters. Those that occur in P at least `least`
times and LIFT times as often as in U are kept, at most MAX_FEATURES by difference of rates: a bounded model, handed to all tasks.

The sample is bounded by documented parameters, MAX_POSITIVE and MAX_UNLABELLED, taken by hash of doc_id. Labels are learned only from
rows whose crc32(doc_id) mod 5 is not 0, and U leaves these rows out too; labels, lang, source and doc_id are never features. Everything
is scored, over whole texts. Texts with exactly the same features count once on each side of the sample.

Null or empty texts have no features and get the score of the intercept. A null doc_id counts as held out. Repeated rows are scored each;
repeated labels of a document count as toxic if one is. Without a confirmed toxic row all scores are 0. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import keep, on_workers
from ledgerlift.llm.packed import text_words

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 16_000
MAX_FEATURES = 512
MEMBERS = 4
LIFT = 3.0
ROUNDS = 300
OUTER = re.compile(r"^\W+|\W+$")
BEGINNINGS = (4, 5, 6)
PARTS = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)) == 0


def features_of(word: str) -> list[str]:
    w = OUTER.sub("", word.lower())
    return [w, *(f"{w[:k]}*" for k in BEGINNINGS if len(w) > k)] if w else []


def _within(rows: DataFrame, bound: int) -> DataFrame:
    """Rows in a share of the hash range that holds about `bound` of them."""
    n = rows.count()
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) < int(PARTS * min(1.0, bound / max(1, n))))


def _word_features(docs: DataFrame) -> DataFrame:
    """(positive, part, features, sketch): the distinct features of each document, a hash of all of them, and a part that follows from the
    hash, so that rows with the same features are equal and it does not matter which one stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = [sorted({f for w in set((t or "").split()) for f in features_of(w)}) for t in rb.column("text").to_pylist()]
            sketch = [xxhash.xxh3_64_intdigest("\n".join(fs)) >> 1 for fs in out]
            yield pa.RecordBatch.from_arrays(
                [rb.column("positive"), pa.array([h % MEMBERS for h in sketch], pa.int64()), pa.array(out, pa.list_(pa.string())), pa.array(sketch, pa.int64())],
                ["positive", "part", "features", "sketch"])
    return docs.mapInArrow(run, "positive boolean, part long, features array<string>, sketch long")


def risk_step(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk and the direction to descend (last weight: intercept)."""
    def loss_and_slope(x: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        z = sign * (x @ w[:-1] + w[-1])
        slope = -sign / (1 + np.exp(np.clip(z, -30, 30))) / max(1, len(x))
        return float(np.logaddexp(0, -z).mean()) if len(x) else 0.0, np.append(slope @ x, slope.sum())
    positive, up = loss_and_slope(xp, 1.0)
    positive_as_negative, down = loss_and_slope(xp, -1.0)
    unlabelled, down_u = loss_and_slope(xu, -1.0)
    corrected = unlabelled - prior * positive_as_negative
    if corrected < 0:
        return prior * positive, -(down_u - prior * down)
    return prior * positive + corrected, prior * up + down_u - prior * down


def fit(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = ROUNDS, rate: float = 0.1) -> np.ndarray:
    """Weights of one classifier by Adam over the whole sample."""
    w = np.zeros(xp.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, g = risk_step(w, xp, xu, prior)
        g = g + np.append(w[:-1], 0.0) * 0.1 / max(1, len(xp))  # the fewer examples, the smaller the weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def learned(docs: DataFrame, labels: DataFrame, least: int = 3) -> tuple[list[str], np.ndarray]:
    """The features kept and the weights of each member (features, then intercept); no members without confirmed toxic rows."""
    on_workers(docs.sparkSession)
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not counts["p"]:
        return [], np.zeros((0, 1))
    prior = min(0.5, max(1e-3, counts["p"] / counts["n"]))
    texts = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    toxic = _within(known.filter("toxic = 1"), MAX_POSITIVE).select("doc_id")
    positive = texts.join(F.broadcast(toxic), "doc_id")  # bounded by MAX_POSITIVE ids
    chosen = positive.select(F.lit(True).alias("positive"), "text").union(
        _within(texts, MAX_UNLABELLED).select(F.lit(False).alias("positive"), "text"))
    sample = keep(_word_features(chosen).dropDuplicates(["positive", "sketch"]), "toxic-sample")  # copies must not vote many times
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p:
        return [], np.zeros((0, 1))
    rates = sample.select("positive", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u"))
    in_p, in_u = F.col("p") / n_p, (F.col("u") + 1) / (n_u + 1)
    kept = rates.filter((F.col("p") >= max(least, n_p // 500)) & (in_p >= LIFT * in_u)).orderBy((in_p - in_u).desc(), "f").limit(MAX_FEATURES)
    names = [r["f"] for r in kept.collect()]  # at most MAX_FEATURES
    place = {f: k for k, f in enumerate(names)}

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(rows), len(names)), np.float32)
        for i, found in enumerate(rows["features"]):
            for f in found:
                if f in place:
                    x[i, place[f]] = 1
        yes = rows["positive"].to_numpy()
        x = x[np.lexsort((*x.T[:8], yes))] if x.shape[1] else x  # the same order in every run
        yes = np.sort(yes)
        return pd.DataFrame({"member": [int(rows["member"].iloc[0])], "w": [fit(x[yes], x[~yes], prior).tolist()]})

    few = sample.select("positive", "part", F.array_intersect("features", F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("features"))
    members = few.select("positive", "features", F.explode(F.filter(F.array(*[F.lit(k) for k in range(MEMBERS)]), lambda k: k != F.col("part"))).alias("member"))
    found = members.groupBy("member").applyInPandas(train, "member int, w array<double>").orderBy("member").collect()
    return names, np.array([r["w"] for r in found])


def scored(docs: DataFrame, names: list[str], weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    on_workers(docs.sparkSession)
    place = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at in range(0, rb.num_rows, 500):
                piece = rb.slice(at, 500)
                lens, coded = text_words(piece.column(1), fold_ascii=False)
                held = [[place[f] for f in features_of(w) if f in place] for w in coded.dictionary.to_pylist()]
                some = np.array([bool(h) for h in held], bool)
                index = coded.indices.to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(lens)), lens)
                hits = np.flatnonzero(some[index]) if len(index) else np.zeros(0, np.int64)
                pairs = {(d, f) for d, i in zip(doc[hits].tolist(), index[hits].tolist()) for f in held[i]}
                score = np.zeros(len(lens))
                if len(weights):
                    z = np.repeat(weights[:, -1:], len(lens), axis=1)
                    for d, f in sorted(pairs):
                        z[:, d] += weights[:, f]
                    score = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(axis=0)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column(0), "held_out": piece.column(2), "score": score, "predicted": pa.array((score >= 0.5).astype(np.int32))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, *learned(docs, labels))
