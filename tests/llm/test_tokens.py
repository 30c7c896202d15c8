import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlift.llm import token_counts, wavelet
from ledgerlift.llm.transducers import CHUNK, FRESH, STATES, boundaries, chunk_maps, compiled, scan, split

from .helpers import DOC, ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = ["", "'", "'r", "'re", "a'rx", " 's", "  's", "\n's", "don't we'll <|endoftext|>x<|endoftext|><|endoftext|>", "aaaa" * 500, "    " * 300, "the" * 300, "é中😀½\u3000 x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(library):
    rng = random.Random(5)
    signs = list("ab'srtevlmdAZ  \n\t\u2003\u3000 1½é中😀!?<>|.,")
    texts = ODD_TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 700))) for _ in range(400)]
    assert compiled(PATH).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_chunk_maps_compose():
    rng = np.random.default_rng(2)
    codes = rng.choice([ord(c) for c in "ab'sre \n1!"], 3000).astype(np.uint32)
    assert boundaries(codes, np.array([3000])).tolist() == np.cumsum([0, *map(len, split(["".join(map(chr, codes))])[0][:-1])]).tolist()
    grid = rng.integers(0, 6, (CHUNK, 5)).astype(np.uint8)
    maps = chunk_maps(grid)
    assert maps.shape == (5, STATES)
    state = FRESH
    for k, entry in enumerate(scan(maps, np.arange(5))):
        assert entry == state
        state = maps[k, state]


def test_counts_of_documents(spark, documents, library):
    rows = token_counts.token_counts(documents, PATH, 512).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    odd = token_counts.token_counts(spark.createDataFrame(ODD, DOC).withColumnRenamed("lang", "n_tokens"), PATH, 1).collect()
    expected = [(i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in ODD]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in odd) == sorted(expected)
    assert all(r.over_limit == (r.n_tokens > 1) for r in odd)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000, 9001):
        x = rng.zipf(1.2, n) % 300
        m = wavelet.WaveletMatrix.build(x, 9)
        assert (m.ids() == x).all()
        assert all(m.access(int(i)) == x[i] for i in (rng.integers(0, n, 20) if n else []))
        lo, hi = n // 4, n // 2
        for token in (0, 1, 2, 299, 511, 600):
            assert m.count(token, lo, hi) == (x[lo:hi] == token).sum()
            assert m.places(token, lo, hi) == (np.flatnonzero(x[lo:hi] == token) + lo).tolist()


def test_shards_read_back(spark, documents, library):
    more = spark.createDataFrame([(None, None), (5000, None), (5001, ""), (5002, "x <|endoftext|> y"), (5002, "it's")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(more)
    rows = sorted(wavelet.written_and_read(docs, PATH, 2).collect(), key=lambda r: r.start)
    start, expected = 0, []
    for d, text in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == expected
    assert wavelet.written_and_read(docs.limit(0), PATH, 2).collect() == []
