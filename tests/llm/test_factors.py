"""Relative Lempel-Ziv parsing against a table of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from ledgerlift.llm import catalog, factors

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows):
    first = {}
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - 19):
            place = (doc_id is not None, doc_id or 0, i)
            first[tuple(w[i:i + 20])] = min(first.get(tuple(w[i:i + 20]), place), place)
    out = []
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i:i + 20])] < (doc_id is not None, doc_id or 0, i) for j in range(i, i + 20)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def edited(rnd, words):
    """A copy with some words changed, dropped or added."""
    out = []
    for w in words:
        if rnd.random() < .02:
            out += rnd.choice([[], ["new"], [w, "more"]])
        else:
            out.append(w)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é\xa0x", "中", "A", "a"]
    passages = [rnd.choices(vocabulary, k=rnd.randint(15, 90)) for _ in range(25)]
    texts = [None, "", " \n\t", " ".join(["same"] * 400), " ".join(["x", "y"] * 150), "one two three", " ".join(passages[0][:19]), " ".join(passages[1][:20])]
    for _ in range(150):
        words = []
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(passages)
            words += rnd.choice([p, p[rnd.randint(0, 9):], edited(rnd, p), rnd.choices(vocabulary, k=30)])
        texts.append(rnd.choice([" ", "\n", " \t "]).join(words))
    rows = [(rnd.choice([k, k, k, k // 2, None]), t) for k, t in enumerate(texts)]
    return rows + rows[10:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows(spark, seed):
    rows = corpus(seed)
    odd = [(*r, 1, "x", 2) for r in rows]
    got = factors.without_copies(spark.createDataFrame(odd, "doc_id long, text string, row long, h string, n int")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    assert sum(r.n_removed for r in got) > 1000


def test_windows_of_equal_words_share_a_seed():
    rnd = random.Random(4)
    passage = [f"p{k}" for k in range(20)]
    import pyarrow as pa
    texts = [" ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 30)) + passage + rnd.choices("abcdefgh", k=9)) for _ in range(50)]
    hashed = factors.Hashed(pa.array(texts))
    best = set()
    for k, t in enumerate(texts):
        at = t.split().index("p0")
        own = hashed.part(k)
        assert hashed.chosen[own.start + at:own.start + at + 10].any()
        best.add(int(hashed.best[own.start + at]))
    assert len(best) == 1


def test_factors_run_on_while_the_reference_does():
    pos, ref = np.array([0, 5, 12, 20, 40, 45]), np.array([100, 105, 112, 130, 0, 5])
    first, after = factors.factored(pos, np.array([1, 1, 1, 1, 2, 2]), ref, 7)
    assert first.tolist() == [0] and after.tolist() == [23]
    assert factors.factored(pos[:3], np.array([7, 7, 7]), pos[:3], 7)[0].tolist() == []  # its own first place


def test_long_texts_and_empty_table(spark):
    rnd = random.Random(5)
    long = " ".join(f"v{rnd.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, long), (2, long), (3, "a " + long[:2000])]
    got = factors.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert factors.without_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, catalog.QUERIES["op11_substring_copies"](spark, data).collect())) == sorted(brute(rows))
