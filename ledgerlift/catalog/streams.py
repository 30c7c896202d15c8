"""Stream jobs run over what is available now; their result equals the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlift.catalog.registry import LOG, USERS, plain, query
from ledgerlift.catalog.usage import _ASKS, _WALK
from ledgerlift.session import ensure_checkpoint_dir
from ledgerlift.sources import metering
from ledgerlift.sources.lines import read_table
from ledgerlift.streaming import jobs


def _run(spark, stream, mode: str = "append") -> str:
    """Run to the end of the available data; results and progress live beside the session's checkpoints."""
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    q = jobs.write_batches(stream, f"{base}/out", f"{base}/progress", mode)
    q.awaitTermination()
    return f"{base}/out"


def _log(spark, d):
    log = metering.request_log(jobs.read_table_stream(spark, d, "events"))
    return log.withColumn("created_at", F.col("created_at").cast("timestamp"))  # watermarks need an instant


def _naive(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("live_kpis", "R2", f"""WITH {LOG} SELECT date_trunc('day', created_at) AS window_start, count(*) AS requests,
  count(CASE WHEN status_code > 399 THEN 1 END) AS errors, CAST(sum(pages_billed) AS BIGINT) AS pages,
  avg(CASE WHEN status_code = 200 THEN processing_time_ms END) AS avg_latency FROM log GROUP BY 1""")
def live_kpis(spark, d):
    return _naive(jobs.latest_per_key(spark, _run(spark, jobs.live_kpis(_log(spark, d)), "update"), ["window_start"]), "window_start")


@query("live_rate_alerts", "R4", f"""WITH {LOG} SELECT api_key, date_trunc('hour', created_at) AS window_start, count(*) AS n
FROM log GROUP BY 1, 2 HAVING count(*) > 1""")
def live_rate_alerts(spark, d):
    """One request per hour, as in the batch report: the given log is too thin for the default limit."""
    alerts = _run(spark, jobs.live_rate_alerts(_log(spark, d), 1, "1 hour"), "update")
    return _naive(jobs.latest_per_key(spark, alerts, ["api_key", "window_start"]), "window_start")


@query("live_sessions", "R5", f"""WITH {LOG}, m AS (SELECT *, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh
  FROM log WINDOW w AS (PARTITION BY api_key ORDER BY created_at)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY api_key ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM m),
g AS (SELECT api_key, min(created_at) AS session_start, max(created_at) + INTERVAL 30 MINUTES AS session_end, count(*) AS requests,
  CAST(sum(pages_billed) AS BIGINT) AS pages FROM s GROUP BY api_key, k)
SELECT g.* FROM g WHERE session_end <= (SELECT max(created_at) - INTERVAL 10 MINUTES FROM log)""")
def live_sessions(spark, d):
    return _naive(spark.read.parquet(_run(spark, jobs.live_sessions(_log(spark, d)))).drop("batch"), "session_start", "session_end")


@query("live_admission", "R3 K16", f"WITH RECURSIVE {LOG}, {USERS}, "
       + _ASKS.replace("AS need,", "AS need, pages_billed AS charge,") + f", {_WALK} SELECT api_key, log_id, accepted FROM walk")
def live_admission(spark, d):
    prepaid = metering.users(read_table(spark, "customer", folder=d)).where(F.col("plan") == "prepaid") \
        .select("api_key", F.col("credits_remaining").alias("credits"))
    asks = _log(spark, d).select("log_id", "api_key", "created_at", F.col("pages_billed").alias("need"), F.col("pages_billed").alias("charge")).join(prepaid, "api_key")
    return spark.read.parquet(_run(spark, jobs.live_admission(asks))).drop("batch")


@query("ingested_documents", "R1 S5", """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(a) AS BIGINT) AS n_lines FROM p""")
def ingested_documents(spark, d):
    """Documents arriving as a stream, each batch put through the batch transforms."""
    from ledgerlift.sources.lines import document_lines
    docs = jobs.read_table_stream(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    q = jobs.write_batches(docs, f"{base}/out", f"{base}/progress",
                           transform=lambda batch: document_lines(batch).groupBy("doc_id").agg(F.count("*").alias("n_lines")))
    q.awaitTermination()
    return plain(spark.read.parquet(f"{base}/out").drop("batch"))
