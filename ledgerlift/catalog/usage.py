"""Usage, billing and error reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.registry import LEADS, LOG, USERS, plain, query
from ledgerlift.operators import usage as U
from ledgerlift.sources import metering
from ledgerlift.sources.lines import read_table


def _log(spark, d):
    return metering.request_log(read_table(spark, "events", folder=d))


def _users(spark, d):
    return metering.users(read_table(spark, "customer", folder=d))


def _leads(spark, d):
    return metering.leads(read_table(spark, "supplier", folder=d))


@query("usage_daily_latency", "K1 S13", f"WITH {LOG} SELECT CAST(created_at AS DATE) AS date, "
       "avg(processing_time_ms) AS avg_speed_ms FROM log WHERE status_code = 200 GROUP BY 1")
def daily_latency(spark, d):
    return U.daily_latency(_log(spark, d))


@query("usage_status_counts", "K2", f"WITH {LOG} SELECT CAST(status_code AS BIGINT) AS status_code, count(*) AS n "
       "FROM log GROUP BY 1")
def status_counts(spark, d):
    return plain(U.status_counts(_log(spark, d)))


@query("users_by_usage", "K3", f"WITH {USERS} SELECT customer_name, plan, pages_processed_this_month, credits_remaining FROM users")
def users_by_usage(spark, d):
    return plain(U.users_by_usage(_users(spark, d)))


@query("pending_lead_count", "K4", f"WITH {LEADS} SELECT count(*) AS pending_requests FROM leads WHERE status = 'Pending'")
def pending_count(spark, d):
    return U.pending_count(_leads(spark, d))


@query("pending_leads", "K4", f"WITH {LEADS} SELECT * FROM leads WHERE status = 'Pending'")
def pending_leads(spark, d):
    return U.pending_leads(_leads(spark, d))


@query("user_lookup", "K5", f"WITH {LOG}, {USERS} SELECT u.* FROM users u WHERE api_key IN (SELECT api_key FROM log WHERE status_code = 500)")
def user_lookup(spark, d):
    failing = _log(spark, d).where(F.col("status_code") == 500).select("api_key")
    return plain(U.find_users(_users(spark, d), keys=failing))


@query("usage_daily_pages_per_key", "K6", f"WITH {LOG} SELECT api_key, CAST(created_at AS DATE) AS date, "
       "CAST(sum(pages_billed) AS BIGINT) AS pages FROM log WHERE status_code = 200 GROUP BY 1, 2")
def daily_pages(spark, d):
    return U.daily_pages_per_key(_log(spark, d))


@query("quota_errors_top10", "K7", f"WITH {LOG} SELECT api_key, log_id, created_at, "
       "'Insufficient credits. Requires ' || pages_billed || ' pages.' AS error_message FROM log WHERE status_code = 402 "
       "QUALIFY row_number() OVER (PARTITION BY api_key ORDER BY created_at DESC, log_id DESC) <= 10")
def quota_errors(spark, d):
    return U.latest_quota_errors(_log(spark, d))


@query("log_page", "K8", f"""WITH {LOG}, c AS (SELECT api_key, count(*) AS total_records,
  greatest(CAST(ceil(count(*) / 10.0) AS BIGINT), 1) AS total_pages FROM log GROUP BY 1)
SELECT l.api_key, log_id, created_at, file_name, pages_billed, CAST(status_code AS BIGINT) AS status_code,
  processing_time_ms, file_size_bytes, total_records, total_pages FROM log l JOIN c ON l.api_key = c.api_key
QUALIFY row_number() OVER (PARTITION BY l.api_key ORDER BY created_at DESC, log_id DESC) BETWEEN 11 AND 20""")
def log_page(spark, d):
    return plain(U.log_page(_log(spark, d), page=2, limit=10))


@query("usage_kpis", "K9", f"""WITH {LOG} SELECT CAST(sum(pages_billed) AS BIGINT) AS total_pages,
  CAST(floor(avg(CASE WHEN status_code = 200 THEN processing_time_ms END)) AS BIGINT) AS avg_latency,
  round(100.0 * count(CASE WHEN status_code > 399 THEN 1 END)::DOUBLE / count(*), 2) AS error_rate FROM log""")
def kpis(spark, d):
    return U.kpis(_log(spark, d))


@query("recent_errors_top10", "K10", f"""WITH {LOG} SELECT log_id, created_at, CAST(status_code AS BIGINT) AS status_code,
  file_name, CASE WHEN status_code = 402 THEN 'Insufficient credits. Requires ' || pages_billed || ' pages.'
  ELSE 'failed ' || file_name END AS error_message,
  CASE WHEN status_code = 500 THEN 'vault\\crash_' || file_name END AS quarantine_path,
  CASE WHEN status_code = 500 THEN 'crash_' || file_name END AS q_filename
FROM log WHERE status_code > 399 ORDER BY created_at DESC, log_id DESC LIMIT 10""")
def recent_errors(spark, d):
    return plain(U.latest_errors(_log(spark, d)))


@query("usage_last_7_days", "K11", f"""WITH {LOG}, a AS (SELECT max(CAST(created_at AS DATE)) AS anchor FROM log)
SELECT CAST(created_at AS DATE) AS date, CAST(sum(pages_billed) AS BIGINT) AS daily_pages FROM log, a
WHERE created_at >= anchor - 7 GROUP BY 1""")
def last_7_days(spark, d):
    log = _log(spark, d)
    # the newest day of the log stands for today: one value from a scan of one column
    anchor = log.agg(F.max(F.to_date("created_at"))).first()[0]
    return U.recent_daily_pages(log, F.lit(anchor))


@query("usage_by_customer", "K12", f"""WITH {LOG}, {USERS} SELECT customer_name, count(log_id) AS total_docs,
  CAST(sum(pages_billed) AS BIGINT) AS total_pages FROM log l JOIN users u ON l.api_key = u.api_key
WHERE status_code = 200 GROUP BY 1""")
def by_customer(spark, d):
    return U.usage_by_customer(_log(spark, d), _users(spark, d))


@query("usage_recent_requests", "K13", f"""WITH {LOG}, {USERS} SELECT customer_name, log_id, file_name, pages_billed, created_at,
  CAST(status_code AS BIGINT) AS status_code, processing_time_ms, file_size_bytes
FROM log l JOIN users u ON l.api_key = u.api_key ORDER BY created_at DESC, log_id DESC LIMIT 20""")
def recent_requests(spark, d):
    return plain(U.recent_requests(_log(spark, d), _users(spark, d)), "customer_name", "log_id", "file_name", "pages_billed",
                 "created_at", "status_code", "processing_time_ms", "file_size_bytes")


@query("billing_lines", "K14", f"""WITH {LOG}, {USERS} SELECT log_id, customer_name AS customer, pages_billed, plan,
  round(file_size_bytes / 1024.0, 2)::DOUBLE AS file_size_kb, processing_time_ms
FROM log l JOIN users u ON l.api_key = u.api_key WHERE status_code = 200""")
def billing_lines(spark, d):
    return U.billing_lines(_log(spark, d), _users(spark, d))


@query("billing_posting", "K15", f"""WITH {LOG}, {USERS}, s AS (SELECT api_key, CAST(sum(pages_billed) AS BIGINT) AS used FROM log
  WHERE status_code = 200 GROUP BY 1)
SELECT u.api_key, customer_name, plan, CASE WHEN plan = 'prepaid' THEN credits_remaining - coalesce(used, 0)
  ELSE credits_remaining END AS credits_remaining,
  pages_processed_this_month + coalesce(used, 0) AS pages_processed_this_month
FROM users u LEFT JOIN s ON u.api_key = s.api_key""")
def billing_posting(spark, d):
    return plain(U.post_charges(_log(spark, d), _users(spark, d)))


@query("monthly_pages", "K15", f"""WITH {LOG} SELECT api_key, CAST(date_trunc('month', created_at) AS DATE) AS month,
  CAST(sum(pages_billed) AS BIGINT) AS pages FROM log WHERE status_code = 200 GROUP BY 1, 2""")
def monthly_pages(spark, d):
    return U.monthly_pages(_log(spark, d))


_ASKS = """asks AS (
  SELECT l.log_id, l.api_key, created_at, pages_billed AS need, credits_remaining AS credits
  FROM log l JOIN users u ON l.api_key = u.api_key WHERE plan = 'prepaid')"""
_WALK = """seq AS (SELECT *, row_number() OVER (PARTITION BY api_key ORDER BY created_at, log_id) AS rn FROM asks),
walk AS (
  SELECT api_key, log_id, rn, credits >= need AS accepted, credits - CASE WHEN credits >= need THEN charge ELSE 0 END AS rest
  FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.api_key, s.log_id, s.rn, w.rest >= s.need, w.rest - CASE WHEN w.rest >= s.need THEN s.charge ELSE 0 END
  FROM walk w JOIN seq s ON s.api_key = w.api_key AND s.rn = w.rn + 1)"""


def _asks(spark, d):
    u = _users(spark, d).where(F.col("plan") == "prepaid").select("api_key", F.col("credits_remaining").alias("credits"))
    return U.attach(_log(spark, d).select("log_id", "api_key", "created_at", F.col("pages_billed").alias("need"),
                                          F.col("pages_billed").alias("charge")), u, ["api_key"], "log_id", how="inner")


@query("credit_admission", "K16", f"WITH RECURSIVE {LOG}, {USERS}, "
       + _ASKS.replace("AS need,", "AS need, pages_billed AS charge,") + f", {_WALK} SELECT api_key, log_id, accepted FROM walk")
def credit_admission(spark, d):
    return U.admit(_asks(spark, d))


_REQUESTS = """requests AS (
  SELECT log_id, CASE WHEN log_id % 41 = 0 THEN 'x' || api_key ELSE api_key END AS api_key, created_at, file_size_bytes,
    CASE WHEN log_id % 50 = 0 THEN 0 ELSE pages_billed END AS pages, log_id % 37 = 0 AS crashes FROM log)"""


@query("request_outcomes", "K17 K16", f"""WITH RECURSIVE {LOG}, {USERS}, {_REQUESTS}, known AS (
  SELECT r.*, plan, credits_remaining, CASE WHEN plan IS NULL THEN 401 WHEN file_size_bytes > 15728640 THEN 413
    WHEN pages = 0 THEN 400 END AS gate FROM requests r LEFT JOIN users u ON r.api_key = u.api_key),
asks AS (SELECT log_id, api_key, created_at, pages AS need, CASE WHEN crashes THEN 0 ELSE pages END AS charge,
  credits_remaining AS credits FROM known WHERE gate IS NULL AND plan = 'prepaid'), {_WALK}
SELECT k.log_id, k.api_key, k.pages, CAST(coalesce(gate, CASE WHEN accepted = false THEN 402 WHEN crashes THEN 500 ELSE 200 END)
  AS BIGINT) AS status_code FROM known k LEFT JOIN walk w ON k.log_id = w.log_id""")
def request_outcomes(spark, d):
    log = _log(spark, d)
    requests = log.select(
        "log_id", F.when(F.col("log_id") % 41 == 0, F.concat(F.lit("x"), "api_key")).otherwise(F.col("api_key")).alias("api_key"),
        "created_at", "file_size_bytes", F.when(F.col("log_id") % 50 == 0, 0).otherwise(F.col("pages_billed")).alias("pages"),
        (F.col("log_id") % 37 == 0).alias("crashes"))
    return plain(U.request_outcomes(requests, _users(spark, d)))


@query("rate_limit_report", "K18", f"""WITH {LOG} SELECT api_key, date_trunc('hour', created_at) AS window_start, count(*) AS n,
  count(*) - 1 AS over FROM log GROUP BY 1, 2 HAVING count(*) > 1""")
def rate_limit_report(spark, d):
    """The limiter at one request per hour: the given log is too thin for the default of 20 per minute."""
    return U.rate_limited(_log(spark, d), limit=1, window="1 hour")


@query("retention_purge", "K19", f"""WITH {LOG}, a AS (SELECT max(created_at) AS newest FROM log)
SELECT log_id, file_name, created_at FROM log, a WHERE status_code = 500 AND created_at < newest - INTERVAL 72 HOURS""")
def retention_purge(spark, d):
    kept = _log(spark, d)
    asof = kept.agg(F.max("created_at")).first()[0]
    return U.expired(kept.where(F.col("status_code") == 500), F.lit(asof)).select("log_id", "file_name", "created_at")


@query("customer_merge", "M1", f"""WITH {USERS}, new AS (
  SELECT 'n' || s_suppkey AS api_key, CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
    ELSE s_name END AS customer_name, 'prepaid' AS plan, CAST(100 AS BIGINT) AS credits_remaining FROM supplier)
SELECT * FROM users UNION ALL SELECT api_key, customer_name, plan, credits_remaining, CAST(0 AS BIGINT) FROM new n
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.customer_name = n.customer_name)""")
def customer_merge(spark, d):
    s = read_table(spark, "supplier", folder=d)
    key = F.col("s_suppkey").cast("string")
    new = s.select(F.concat(F.lit("n"), key).alias("api_key"), F.when(
        F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(key, 9, "0"))).otherwise(F.col("s_name")).alias("customer_name"),
        F.lit("prepaid").alias("plan"), F.lit(100).cast("bigint").alias("credits_remaining"))
    return plain(U.add_customers(_users(spark, d), new))


@query("lead_approval", "M2", f"""WITH {LEADS} SELECT id, company_name, email, requested_at,
  CASE WHEN company_name IN (SELECT s_name FROM supplier WHERE s_acctbal > 5000) THEN 'Approved' ELSE status END AS status FROM leads""")
def lead_approval(spark, d):
    rich = read_table(spark, "supplier", folder=d).where(F.col("s_acctbal") > 5000).select(F.col("s_name").alias("customer_name"))
    return U.approve_leads(_leads(spark, d), rich)


_CHANGES = """changes AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'gone' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS api_key,
  'prepaid' AS plan, CAST(500 AS BIGINT) AS credits_remaining FROM customer WHERE c_nationkey = 3)"""


def _changes(spark, d):
    key = F.col("c_custkey").cast("string")
    return read_table(spark, "customer", folder=d).where(F.col("c_nationkey") == 3).select(
        F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("gone"), key)).otherwise(key).alias("api_key"),
        F.lit("prepaid").alias("plan"), F.lit(500).cast("bigint").alias("credits_remaining"))


@query("plan_update", "M3", f"""WITH {USERS}, {_CHANGES} SELECT u.api_key, customer_name, coalesce(c.plan, u.plan) AS plan,
  coalesce(c.credits_remaining, u.credits_remaining) AS credits_remaining, pages_processed_this_month
FROM users u LEFT JOIN changes c ON u.api_key = c.api_key""")
def plan_update(spark, d):
    return plain(U.update_customers(_users(spark, d), _changes(spark, d)))


@query("plan_update_not_found", "M3", f"WITH {USERS}, {_CHANGES} SELECT * FROM changes WHERE api_key NOT IN (SELECT api_key FROM users)")
def plan_update_not_found(spark, d):
    return U.not_found(_users(spark, d), _changes(spark, d))


_MAP = "m AS (SELECT CAST(c_custkey AS VARCHAR) AS old_key, 'k' || (c_custkey * 3) AS new_key FROM customer WHERE c_custkey % 4 = 1)"


def _mapping(spark, d):
    c = read_table(spark, "customer", folder=d).where(F.col("c_custkey") % 4 == 1)
    return c.select(F.col("c_custkey").cast("string").alias("old_key"),
                    F.concat(F.lit("k"), (F.col("c_custkey") * 3).cast("string")).alias("new_key"))


@query("key_rotation_log", "M4", f"""WITH {LOG}, {_MAP} SELECT log_id, coalesce(new_key, api_key) AS api_key, pages_billed
FROM log LEFT JOIN m ON api_key = old_key""")
def key_rotation_log(spark, d):
    log = _log(spark, d).select("log_id", "api_key", "pages_billed")
    return U.rotate_keys(log, _mapping(spark, d), "log_id")


@query("key_rotation_users", "M4", f"WITH {USERS}, {_MAP} SELECT coalesce(new_key, api_key) AS api_key, customer_name FROM users LEFT JOIN m ON api_key = old_key")
def key_rotation_users(spark, d):
    return U.rotate_keys(_users(spark, d).select("api_key", "customer_name"), _mapping(spark, d), "customer_name")
