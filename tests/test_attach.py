"""Joins of per-key facts: equal results for few and many keys, and no copy of many facts on the driver."""

import pytest
from pyspark.sql import functions as F

from ledgerlift.operators import ordered, usage
from ledgerlift.operators.headers import header_facts
from ledgerlift.operators.ordered import attach, scan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [10, 10_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_few_and_many(spark, monkeypatch, limit, how):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame([(str(i % 60) if i % 7 else None, i) for i in range(500)], "k string, i long")
    facts = spark.createDataFrame([(str(k), k * 2) for k in range(40)], "k string, v long")
    got = {r.i: r.v for r in attach(df, facts, ["k"], "i", how=how).collect()}
    want = {i: (i % 60) * 2 if i % 7 and i % 60 < 40 else None for i in range(500)}
    assert got == {i: v for i, v in want.items() if how == "left" or v is not None}


def test_many_facts_are_not_broadcast(spark):
    """Small files may hold many facts."""
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("k"), "id")
    facts = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    assert "Broadcast" not in plan(attach(df, facts, ["k"], "id"))
    assert "Broadcast" in plan(attach(df, facts.limit(100), ["k"], "id"))


def test_edges_of_many_groups_are_not_broadcast(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("p"))
    assert "Broadcast" not in plan(scan(df, ["k"], "p", sums={"n": F.lit(1)}))


def test_outcomes_of_many_requests_are_not_broadcast(spark):
    requests = spark.range(20_000).select(F.col("id").alias("log_id"), F.col("id").cast("string").alias("api_key"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
                                          F.lit(1).alias("file_size_bytes"), F.lit(1).alias("pages"), F.lit(False).alias("crashes"))
    users = requests.select("api_key", F.lit("prepaid").alias("plan"), F.lit(5).cast("bigint").alias("credits_remaining"))
    out = usage.request_outcomes(requests, users)
    assert "Broadcast" not in plan(out) and out.where("status_code = 200").count() == 20_000


def test_facts_of_many_documents_are_not_broadcast(spark):
    lines = spark.range(20_000).select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("page_no"), F.lit(0).cast("bigint").alias("line_no"),
                                       F.lit("STATION ROAD").alias("text"))
    facts = header_facts(lines)
    assert "Broadcast" not in plan(facts) and facts.where("address = 'STATION ROAD'").count() == 20_000
