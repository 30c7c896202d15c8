"""The operators as registered queries over the whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.llm import alignment, factors, jaccard, line_runs, lm_score, manifest, mixing, quality, templates, token_counts, toxicity, url_rules, wavelet
from ledgerlift.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TARGETS = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": {"prose": 0.6, "long": 0.3}}
SHARE = 0.5  # of all tokens, to be sampled


@query("op1_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.sampled(docs, TARGETS, SHARE, TOKENIZER, columns=["doc_id"])


END_ID = 2  # appended to each document


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, 512)


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), columns=["doc_id"])


@query("op4_wavelet_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.written_and_read(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block")]


@query("op6_url_rules", r"""
WITH u AS (
  SELECT page_id, coalesce(strpos(url, '://'), 0) AS p, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
parts AS (
  SELECT page_id, CASE WHEN p = 0 THEN '' ELSE translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN p = 0 THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path
  FROM u),
rules(r_host, r_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
  coalesce(arg_max(verdict, length(r_host || r_path)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
GROUP BY page_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, url_rules.RULES))


@query("op7_templates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", "item_id", "n_tokens", "n_covered", "n_slots", "same_values")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_line_runs")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_lm_score", f"""
WITH w0 AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w0),
g AS (SELECT doc_id, i, w, lag(w, 1) OVER p AS w1, lag(w, 2) OVER p AS w2 FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
    CASE WHEN w1 IS NOT NULL THEN count(*) OVER (PARTITION BY w1, w) - count(*) OVER (PARTITION BY doc_id, w1, w) ELSE 0 END AS c2,
    CASE WHEN w2 IS NOT NULL THEN count(*) OVER (PARTITION BY w2, w1, w) - count(*) OVER (PARTITION BY doc_id, w2, w1, w) ELSE 0 END AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS others
  FROM g),
s AS (SELECT *, lag(c1) OVER p AS p1, lag(c2) OVER p AS p2 FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT doc_id, c1, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 ELSE 1 END AS used, least(i, 3) AS top,
    CASE WHEN c3 > 0 THEN ln(c3) - ln(p2) WHEN c2 > 0 THEN ln(c2) - ln(p1) ELSE ln(greatest(c1, 0.5)) - ln(others + 1) END AS l
  FROM s)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(b, 0) AS n_backoff, coalesce(u, 0) AS n_unseen, coalesce(round(x, 6), 0.0) AS log_score,
  round(x / n, 6) AS mean_log_score
FROM (SELECT doc_id FROM documents) d LEFT JOIN (
  SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN top > used THEN 1 ELSE 0 END) AS BIGINT) AS b,
    CAST(sum(CASE WHEN used = 1 AND c1 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS u, sum(l + (top - used) * ln(0.4)) AS x
  FROM r GROUP BY doc_id) USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.backoff_scores(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scores.select("doc_id", "n_words", "n_backoff", "n_unseen", F.round("log_score", 6).alias("log_score"), mean.alias("mean_log_score"))


@query("op11_substring_copies")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.without_copies(table(spark, sf_dir, "documents"))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def _sql_fields(text: str) -> str:
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ["doc_id", "source", "lang", "n_chars", text])


def _sql_walk(walk: str, level: str, start: str) -> str:
    """A node's climb through the runs of its tree: fold and siblings so far."""
    return f"""{walk}(row, lang, level, pos, folded, sibs) AS ({start}
  UNION ALL
  SELECT w.row, w.lang, w.level + 1, w.pos // 8, sha256(array_to_string(nodes[1:pos % 8], '') || folded || array_to_string(nodes[pos % 8 + 2:], '')),
    sibs || array_to_string(nodes[1:pos % 8], '') || array_to_string(nodes[pos % 8 + 2:], '')
  FROM {walk} w JOIN {level} r ON r.lang IS NOT DISTINCT FROM w.lang AND r.level = w.level AND r.run = w.pos // 8)"""


@query("op13_manifest", f"""
WITH RECURSIVE leaf AS (
  SELECT *, row_number() OVER () AS row, sha256({_sql_fields("text")}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
      lambda crc, b: list_reduce(range(8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(crc, b)), 4294967295), 4294967295) % 3 = 0
      THEN sha256({_sql_fields("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS altered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
nodes(lang, level, pos, node, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8),
runs AS (SELECT lang, level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM nodes WHERE n > 1 GROUP BY ALL),
{_sql_walk("walk", "runs", "SELECT row, lang, 0, pos, coalesce(altered, leaf), '' FROM placed")},
subroots AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1),
tops(lang, level, pos, node, n) AS (
  SELECT 0, 0, pos, node, count(*) OVER () FROM subroots
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM tops WHERE n > 1 GROUP BY lang, level, pos // 8),
top_runs AS (SELECT lang, level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM tops WHERE n > 1 GROUP BY ALL),
done AS (SELECT row, lang, arg_max(folded, level) AS folded, arg_max(sibs, level) AS sibs FROM walk GROUP BY row, lang),
{_sql_walk("top_walk", "top_runs", "SELECT row, 0, 0, pos, folded, sibs FROM done JOIN subroots s ON s.lang IS NOT DISTINCT FROM done.lang")},
proven AS (SELECT row, arg_max(folded, level) AS folded, arg_max(sibs, level) AS sibs FROM top_walk GROUP BY row)
SELECT doc_id, leaf, s.node AS subroot, t.node AS root, sha256(sibs) AS proof_sha256, folded AS folded_root, folded = t.node AS verified
FROM leaf JOIN proven USING (row) JOIN subroots s ON s.lang IS NOT DISTINCT FROM leaf.lang JOIN tops t ON t.n = 1""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))
