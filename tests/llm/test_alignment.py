"""Alignment against whole texts encoded by the libraries and compared end by end."""

import base64
import bisect
import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlift.llm import alignment, catalog

TEXTS = [None, "", " ", "  a", "a ", "a  b", "\n", " \n x \t y", "a  b 　c", "x\x1c \x1cy", "▁x", "a ▁ b", "don't we'll 123 4567",
         "<|endoftext|> <s> </s> <unk> <0x41>", "é中😀½ ﬁ", "a" * 3000, " " * 300, "word " * 500, "The of and the that\nThe of and.", "\x00 \x7f \r\n"]

RANKS = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(catalog.TOKENIZER.replace(".json", ".tiktoken"), "rb"))}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(catalog.TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=catalog.PIECES)


def of_a(lib, text):
    """Ids and their bytes, from the offsets into the text and the byte-level alphabet of a second library."""
    ids = lib.encode(" " + text, add_special_tokens=False).ids
    return ids, [RANKS[i] for i in ids]


def of_b(lib, text):
    ids = lib.encode(text)
    return ids, [bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace("▁", " ").encode() for i in ids]


def brute(rows, libraries):
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            (a, ta), (b, tb) = of_a(libraries[0], text), of_b(libraries[1], text)
            if b"".join(ta) == b"".join(tb) == (" " + text).encode():
                ea, eb = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
                p = q = 0
                for e in sorted(set(ea) & set(eb)):
                    i, j = bisect.bisect(ea, e), bisect.bisect(eb, e)
                    groups.append((a[p:i], b[q:j]))
                    p, q = i, j
        links = [(g[0][-1], g[1][-1]) for g in groups]
        counts.update(links)
        docs.append((doc_id, groups, links))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def test_runs_are_jumped_and_groups_closed():
    rnd = random.Random(3)
    for _ in range(300):
        ends = sorted(rnd.sample(range(1, 4000), rnd.randint(1, 900)))
        a = [e for e in ends[:-1] if rnd.random() < rnd.choice([.5, .99])] + ends[-1:]
        b = [e for e in ends[:-1] if rnd.random() < rnd.choice([.5, .99])] + ends[-1:]
        sizes = alignment.group_sizes(np.array(a), np.array(b))
        shared = sorted(set(a) & set(b))
        assert np.cumsum(sizes[0]).tolist() == [bisect.bisect(a, e) for e in shared]
        assert np.cumsum(sizes[1]).tolist() == [bisect.bisect(b, e) for e in shared]


def test_long_one_to_one_stretches_take_few_comparisons():
    class Counted(list):
        looks = 0

        def __getitem__(self, k):
            Counted.looks += 1
            return list.__getitem__(self, k)

    n = 100_000
    ends = list(range(1, n + 1))
    assert alignment.align(Counted(ends), Counted(ends)) == ([], [], []) and Counted.looks < 200


@pytest.mark.parametrize("broadcast_pairs", [10**6, 0])
def test_documents_and_counts(spark, libraries, broadcast_pairs):
    rnd = random.Random(7)
    signs = list("abthe'srd  \n\t é中😀½.,<>|0xA1▁")
    words = ["the", "tion", "Onhalyti", "ing", "é", "  ", "\n", "don't"]
    texts = TEXTS + ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    texts += [" ".join(rnd.choices(words, k=rnd.randint(1, 300))) for _ in range(100)]
    rows = [(rnd.choice([None, k, k // 2]), t) for k, t in enumerate(texts)] + [(1, "twice"), (1, "twice")]
    odd = [(*r, 5, "x") for r in rows]
    docs = spark.createDataFrame(odd, "doc_id long, text string, row long, pairs string")
    got = alignment.alignment(docs, catalog.TOKENIZER, catalog.PIECES, broadcast_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, libraries), key=key)


def test_units_are_forgotten_and_encoded_again(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_TOKENS", 50)
    pair = alignment.Pair(catalog.TOKENIZER, catalog.PIECES)
    texts = [f"word{k} other{k // 3} and  the" for k in range(200)]
    seen = [d["groups_sha256"] for at in range(0, 200, 10) for d in pair.documents(texts[at:at + 10])]
    assert seen == [r[-1] for r in brute(list(enumerate(texts)), libraries)]


def test_no_documents_and_whole_table(spark, data, libraries):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(empty, catalog.TOKENIZER, catalog.PIECES).collect() == []
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, catalog.QUERIES["op12_alignment"](spark, data).collect())) == sorted(brute(rows, libraries))
