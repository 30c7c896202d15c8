import bisect
import collections
import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlift.llm import catalog, lm_score, mixing, quality, toxicity, units, url_rules

from .helpers import DOC, ODD, base, raked


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def norm(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_lm_odd_rows(spark):
    found = lm_score.backoff_scores(spark.createDataFrame(ODD, DOC)).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in found) == [(0, 0), (1, 0), (2, 0), (2, 2), (2, 2)]
    # the twin holds both words and the pair: a once among 2 + 1, b after a once of once
    assert [round(r.log_score, 6) for r in found if r.n_words] == [round(float(np.log(1 / 3)), 6)] * 2
    assert lm_score.backoff_scores(spark.createDataFrame([], DOC)).collect() == []


def test_url_odd_rows(spark):
    rows = [(1, None), (1, None), (2, "no scheme"), (None, "http://EXAMPLE.org/es/x?q#f"), (4, "http://notexample.org/es/"), (5, "http://org"), (6, "x://a.com:80/de/")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, rule int")
    rules = spark.createDataFrame(catalog.URL_RULES, url_rules.RULES)
    found = collections.Counter(tuple(r) for r in url_rules.judge(pages, rules).collect())
    assert found == collections.Counter({
        (1, "", "", None, "allow"): 2, (2, "", "", None, "allow"): 1, (None, "example.org", "/es/x", "example.org/es/", "block"): 1,
        (4, "notexample.org", "/es/", "org/", "allow"): 1, (5, "org", "", None, "allow"): 1, (6, "a.com:80", "/de/", None, "allow"): 1})
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0), "block").collect()} == {"block"}


def test_quality(spark, documents, data):
    rows = quality.judged(documents, ["doc_id", "text"]).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert not (r.base_failed and r.kept)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    judged = [(good[r.doc_id], r.kept) for r in rows if r.doc_id in good and not r.base_failed]
    assert judged and all(q == kept for q, kept in judged)


def test_quality_odd_rows(spark):
    odd = quality.judged(spark.createDataFrame(ODD, DOC).selectExpr("*", "1 AS kept", "2 AS extra")).collect()
    assert len(odd) == 5 and not any(r.kept for r in odd) and {r.extra for r in odd} == {2}
    assert quality.judged(spark.createDataFrame([], DOC)).collect() == []


def test_estimates_match_brute_force(spark):
    """One group, steps and floors as documented, with distances from numpy."""
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 1, (400, 4)), rng.normal(9, 0.5, (60, 4))))
    df = spark.createDataFrame([(1, *map(float, v)) for v in x], "group int, x1 double, x2 double, x3 double, x4 double")
    row = quality.estimates(df, 10).first()
    q = np.percentile(np.round(x * 64) / 64, [25, 50, 75], axis=0)
    floors = np.diag(np.square(quality.FLOORS))
    mean, cov = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floors
    for step in range(quality.STEPS + 1):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        b = np.floor(np.log1p(d) / quality.BIN)
        last = step == quality.STEPS
        below = np.array([(b < v).sum() for v in b])
        inner = np.expm1(b * quality.BIN) <= quality.REWEIGHT if last else below < quality.COVERAGE * len(x)
        mean = x[inner].mean(axis=0)
        cov = np.cov(x[inner].T, bias=True) * (1 if last else quality.CONSISTENCY) + floors
    assert np.allclose([row[f"m_{i}"] for i in range(4)], mean)
    low = np.zeros((4, 4))
    for i, j in quality.PAIRS:
        low[i, j] = row[f"l_{i}_{j}"]
    assert np.allclose(low @ low.T, cov)
    assert np.abs(mean).max() < 0.3  # the outlying cluster did not move it


def test_raking(spark):
    rng = np.random.default_rng(6)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): float(rng.integers(1, 100)) for a in range(4) for b in range(3) for c in range(2)}
    df = spark.createDataFrame([(*c, int(w)) for c, w in cells.items()], "source string, lang string, topic string, w long")
    parts = {"lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}, "topic": {"t0": 0.9, "t1": 0.1}, "source": {"s0": 0.4}}
    total = sum(cells.values())
    sums = [collections.Counter() for _ in range(3)]
    for c, w in cells.items():
        for d in range(3):
            sums[d][c[d]] += w
    roots = sum(w ** 0.5 for s, w in sums[0].items() if s != "s0")
    targets = [{s: total * (0.4 if s == "s0" else 0.6 * w ** 0.5 / roots) for s, w in sums[0].items()},
               {k: v * total for k, v in parts["lang"].items()}, {k: v * total for k, v in parts["topic"].items()}]
    expected = raked(cells, targets, 5)
    for r in mixing.raked(df, parts, 5, tolerance=0.0).collect():
        assert abs(r.raked - expected[r.source, r.lang, r.topic]) < 1e-6
    done = mixing.raked(df, parts, 50, tolerance=1e-3).collect()
    assert {r.margin_error for r in done} == {max(r.margin_error for r in done)} and done[0].margin_error <= 1e-3
    have = collections.Counter()
    for r in done:
        have[r.lang] += r.raked
    assert all(abs(have[k] - v) < 2e-3 * v for k, v in targets[1].items())


def test_plans_do_not_grow_with_rounds(spark):
    df = spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 7), ("b", "x", "u", 9)], "source string, lang string, topic string, w long")
    nodes = [mixing.raked(df, catalog.TARGETS, n, tolerance=0.0)._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (1, 3)]
    assert nodes[0] == nodes[1]


def test_sampling(spark, documents):
    rows = mixing.sampled(documents, catalog.TARGETS, catalog.SHARE, catalog.TOKENIZER, ["doc_id", "lang", "text"]).collect()
    library = Tokenizer.from_file(catalog.TOKENIZER)
    assert [r.n_tokens for r in rows] == [len(e.ids) for e in library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    tokens = sum(r.n_tokens for r in rows)
    assert abs(sum(r.probability * r.n_tokens for r in rows) - catalog.SHARE * tokens) < 0.01 * tokens
    for lang, part in catalog.TARGETS["lang"].items():
        assert abs(sum((r.factor or 0) * r.n_tokens for r in rows if r.lang == lang) - part * tokens) < 0.001 * tokens
    assert all(r.taken == (r.uniform < r.probability) for r in rows) and 0 < sum(r.taken for r in rows) < len(rows)
    odd = mixing.sampled(spark.createDataFrame(ODD, DOC).selectExpr("*", "'x' AS topic", "1 AS w"), catalog.TARGETS, 0.5, catalog.TOKENIZER).collect()
    assert len(odd) == 5 and not any(r.taken for r in odd if not r.n_tokens) and {r.w for r in odd} == {1}
    assert mixing.sampled(spark.createDataFrame([], DOC), catalog.TARGETS, 0.5, catalog.TOKENIZER).collect() == []
    unnamed = spark.createDataFrame([(None, f"text number {k}", "en", "s") for k in range(200)], DOC)
    assert 40 < sum(r.taken for r in mixing.sampled(unnamed, {}, 0.5, catalog.TOKENIZER).collect()) < 160


def test_units_have_the_tokens_of_whole_texts(monkeypatch):
    rng = random.Random(8)
    signs = list("abthe'srd   \n\t\u00a0é中😀½.,<|>0\0")
    texts = [None, "", " ", "  a", "a ", "a  b", "a\u3000 b", "x <|endoftext|> y", "a<|endoftext|>", "a\0 b", "\x1c a"] * 2
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(300)] + ["some words of a text"] * 3
    library = Tokenizer.from_file(catalog.TOKENIZER)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(units, "KEPT_UNITS", 300)
    counts = units.UnitCounts(catalog.TOKENIZER)
    assert [n for at in range(0, len(texts), 50) for n in counts.count(texts[at:at + 50]).tolist()] == want


def test_non_negative_risk():
    xp, xu = np.ones((4, 1)), np.zeros((6, 1))
    w = np.array([5.0, -5.0])
    risk, slope = toxicity.risk_step(w, xp, xu, 0.5)
    # unlabelled texts fit better than the prior allows: the corrected part is cut at zero
    assert risk == pytest.approx(0.5 * np.log(2))
    eps = 1e-6
    w = np.array([0.5, -0.2])
    numeric = [(toxicity.risk_step(w + eps * e, xp, xu, 0.2)[0] - toxicity.risk_step(w - eps * e, xp, xu, 0.2)[0]) / (2 * eps) for e in np.eye(2)]
    assert np.allclose(toxicity.risk_step(w, xp, xu, 0.2)[1], numeric, atol=1e-4)


def test_toxicity_sample_drops_exact_copies_only(spark):
    shared = " ".join(f"word{k}" for k in range(60))
    texts = [f"{shared} own{k}" for k in range(30)] + ["own0, " + shared, None, ""]
    rows = toxicity._word_features(spark.createDataFrame([(True, 0, t) for t in texts], "positive boolean, part long, text string")).collect()
    assert len({r.sketch for r in rows}) == len({tuple(r.features) for r in rows}) == 31
    assert len({(r.sketch, r.part) for r in rows}) == 31 and {r.part for r in rows} <= set(range(toxicity.MEMBERS))


def test_toxicity_held_out(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) == docs.count()
    yes = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 1]
    no = sorted(r.score for r in rows if r.held_out and truth.get(r.doc_id) == 0)
    assert sum(bisect.bisect_left(no, s) for s in yes) / len(yes) / len(no) > 0.75  # a few dozen toxic rows to learn from
    odd = toxicity.toxicity(spark.createDataFrame(ODD, DOC).selectExpr("*", "1 AS score"), labels.limit(0)).collect()
    assert len(odd) == 5 and {r.score for r in odd} == {0.0}
