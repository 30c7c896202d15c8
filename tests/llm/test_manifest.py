"""The Merkle manifest against trees built one node at a time, and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from ledgerlift.llm import catalog, manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOW = str.maketrans(manifest.UPPER, manifest.LOWER)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root, and for each node its siblings (before, after) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = p // 8 * 8
            paths[k].append((nodes[run:p], nodes[p + 1:run + 8]))
            at[k] = p // 8
        nodes = [sha(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = []
    for lang in langs:
        own = sorted(((r, sha(*map(field, r))) for r in rows if r[2] == lang), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        groups.append((own, *tree([leaf for _, leaf in own])))
    root, tops = tree([sub for _, sub, _ in groups]) if groups else (None, [])
    out = []
    for (own, sub, paths), top in zip(groups, tops):
        for (r, leaf), path in zip(own, paths):
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = sha(*map(field, (*r[:4], r[4] and r[4].translate(LOW))))
            for left, right in path + top:
                node = sha(*left, node, *right)
            out.append((r[0], leaf, sub, root, sha(*[x for a, b in path + top for x in a + b]), node, node == root))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def made(n, seed=1):
    """(doc_id, source, lang, n_chars, text): nulls, repeated ids and rows, one lang with most rows, many small ones."""
    rnd = random.Random(seed)
    return [(None if rnd.random() < .05 else rnd.randrange(n), rnd.choice(["a", None]),
             rnd.choice(["en"] * 9 + ["é", None, "", str(rnd.randrange(20))]), rnd.choice([None, 3]),
             rnd.choice([None, "", "Abc É", "xyz", f"Q{rnd.randrange(n)}"])) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 65, 5000])
def test_equals_trees_built_by_hand(spark, n):
    rows = made(n)
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_more_columns_and_long_texts(spark):
    rows = [(1, "s", "en", 2, "A" * 2_000_000), (2, "s", "en", 2, "b"), (2, "s", "en", 2, "b")]
    odd = [(*r, 7, "x", "y") for r in rows]
    got = manifest.manifest(spark.createDataFrame(odd, SCHEMA + ", leaf long, grp string, path string")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.sql(catalog.ORACLES["op13_manifest"])
    got = catalog.QUERIES["op13_manifest"](spark, data).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 100
