"""URL filter by rules on host suffixes and path prefixes.

A url is expanded into expressions: each suffix of its host (whole host, then from each dot on) with each prefix of its path that
has the length of some rule's path. Expressions and rules meet by an equi-join on a short hash prefix; the full digests confirm.
Among the rules that fit, the longest (host and path together) wins; of equal ones the longer host, then block before allow.
Without a rule the default verdict holds.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path goes on to `?`, `#` or the end.
Null urls and urls without `://` have an empty host and path and get the default verdict. Rows are judged one by one, so repeated
rows repeat; further columns of pages are ignored. An empty rule table leaves the default. Work is done once per distinct host and
path, so a common host costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT_BITS = 32        # of the digest, joined on
MAX_RULE_PATH = 4096   # longest path of a rule; bounds the list of lengths that the driver reads
RULES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, SHORT_BITS // 4), 16, 10).cast("long")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url) with host, path, rule (host and path of the deciding rule, or null) and verdict."""
    asked = rules.select(F.lower("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    lengths = [r[0] for r in asked.select(F.length("r_path")).distinct().limit(MAX_RULE_PATH + 1).collect()]
    if any(n > MAX_RULE_PATH for n in lengths):
        raise ValueError(f"a rule's path is longer than {MAX_RULE_PATH}")
    asked = asked.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("short", _short(F.col("r_digest")))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    suffixes = F.transform(F.split("host", r"\."), lambda _, i: F.concat_ws(".", F.slice(F.split("host", r"\."), i + 1, F.size(F.split("host", r"\.")))))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))) if lengths else F.array().cast("array<int>"),
                                    lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (urls.select("host", "path").distinct().filter("host <> ''")
                   .withColumn("e_host", F.explode(suffixes)).withColumn("e_path", F.explode(prefixes))
                   .withColumn("digest", _digest(F.col("e_host"), F.col("e_path"))).withColumn("short", _short(F.col("digest"))))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.col("r_verdict").alias("verdict"),
                    F.concat("r_host", "r_path").alias("rule"))
    best = (expressions.join(asked, "short").filter(F.col("digest") == F.col("r_digest"))
            .groupBy("host", "path").agg(F.max(rank).alias("best")))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
