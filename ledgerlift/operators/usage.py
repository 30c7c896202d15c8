"""Usage, billing and error reports over the request log, and changes to the metering tables.

Grouping by API key always aggregates on the map side first, and top-n lists per
key use a rank limit that Spark applies before the shuffle, so one key holding
much of the log stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.operators.ordered import attach, first_rows, scan
from ledgerlift.session import cut, staged

MAX_BYTES = 15 * 1024 * 1024
RETENTION_HOURS = 72
RATE_LIMIT, RATE_WINDOW = 20, "1 minute"
FOLD_LIMIT = 2_000
NEWEST = ["created_at", "log_id"]


def _newest() -> list[Column]:
    return [F.col(c).desc() for c in NEWEST]


def daily_latency(log: DataFrame) -> DataFrame:
    """Mean processing time of successes per day."""
    return log.where(F.col("status_code") == 200).groupBy(F.to_date("created_at").alias("date")).agg(
        F.avg("processing_time_ms").alias("avg_speed_ms"))


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status_code").agg(F.count("*").alias("n"))


def users_by_usage(users: DataFrame) -> DataFrame:
    return users.select("customer_name", "plan", "pages_processed_this_month", "credits_remaining").orderBy(
        F.desc("pages_processed_this_month"), "customer_name")


def pending_count(leads: DataFrame) -> DataFrame:
    return leads.where(F.col("status") == "Pending").agg(F.count("*").alias("pending_requests"))


def pending_leads(leads: DataFrame) -> DataFrame:
    return leads.where(F.col("status") == "Pending").orderBy(F.desc("requested_at"), "id")


def find_users(users: DataFrame, keys: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Users by key or by name, for any number of them."""
    if keys is not None:
        users = users.join(keys, "api_key", "left_semi")
    return users if names is None else users.join(names, "customer_name", "left_semi")


def daily_pages_per_key(log: DataFrame) -> DataFrame:
    return log.where(F.col("status_code") == 200).groupBy("api_key", F.to_date("created_at").alias("date")).agg(
        F.sum("pages_billed").alias("pages"))


def latest_quota_errors(log: DataFrame, n: int = 10) -> DataFrame:
    """Latest n quota errors of each key."""
    return first_rows(log.where(F.col("status_code") == 402).select("api_key", "log_id", "created_at", "error_message"),
                      ["api_key"], _newest(), n)


def log_page(log: DataFrame, page: int = 1, limit: int = 10) -> DataFrame:
    """One page of every key's log, newest first, with the key's record and page counts."""
    slim = log.select("api_key", "log_id", "created_at", "file_name", "pages_billed", "status_code", "processing_time_ms",
                      "file_size_bytes")
    newest = Window.partitionBy("api_key").orderBy(*_newest())
    # the upper bound limits rows per key before the shuffle; the lower bound then cuts the page out
    shown = slim.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= page * limit)
    return shown.where(F.col("rn") > (page - 1) * limit).join(page_counts(log, limit), "api_key").drop("rn")


def page_counts(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.groupBy("api_key").agg(F.count("*").alias("total_records")).withColumn(
        "total_pages", F.greatest(F.ceil(F.col("total_records") / limit), F.lit(1)).cast("bigint"))


def kpis(log: DataFrame) -> DataFrame:
    """Pages billed, mean latency of successes and error rate, in one scan."""
    ok = F.col("status_code") == 200
    bad = F.count(F.when(F.col("status_code") > 399, 1))
    return log.agg(
        F.coalesce(F.sum("pages_billed"), F.lit(0)).cast("bigint").alias("total_pages"),
        F.coalesce(F.floor(F.avg(F.when(ok, F.col("processing_time_ms")))), F.lit(0)).cast("bigint").alias("avg_latency"),
        F.when(F.count("*") > 0, F.round(bad / F.count("*") * 100, 2)).otherwise(F.lit(0.0)).alias("error_rate"))


def latest_errors(log: DataFrame, n: int = 10) -> DataFrame:
    """Latest n failed requests with the base name of the kept file."""
    rows = log.where(F.col("status_code") > 399).orderBy(*_newest()).limit(n)
    return rows.select("log_id", "created_at", "status_code", "file_name", "error_message", "quarantine_path",
                       F.element_at(F.split("quarantine_path", r"[/\\]"), -1).alias("q_filename"))


def recent_daily_pages(log: DataFrame, anchor: Column | None = None, days: int = 7) -> DataFrame:
    """Pages per day of the last days before the anchor (today when none is given)."""
    since = F.date_sub(anchor if anchor is not None else F.current_date(), days)
    return log.where(F.col("created_at") >= since).groupBy(F.to_date("created_at").alias("date")).agg(
        F.sum("pages_billed").alias("daily_pages"))


def usage_by_customer(log: DataFrame, users: DataFrame) -> DataFrame:
    """Documents and pages per customer: summed per key before the join."""
    per_key = log.where(F.col("status_code") == 200).groupBy("api_key").agg(
        F.count("log_id").alias("docs"), F.sum("pages_billed").alias("pages"))
    return per_key.join(users.select("api_key", "customer_name"), "api_key").groupBy("customer_name").agg(
        F.sum("docs").alias("total_docs"), F.sum("pages").alias("total_pages"))


def recent_requests(log: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """Latest n requests with customer names. Each key's latest n are enough, so the join sees few rows of any key."""
    top = first_rows(log.select("api_key", "log_id", "file_name", "file_url", "pages_billed", "created_at", "status_code",
                                "processing_time_ms", "file_size_bytes"), ["api_key"], _newest(), n)
    return top.join(users.select("api_key", "customer_name"), "api_key").orderBy(*_newest()).limit(n)


def billing_lines(log: DataFrame, users: DataFrame) -> DataFrame:
    """What each served request is billed."""
    rows = attach(log.where(F.col("status_code") == 200), users.select("api_key", "customer_name", "plan"), ["api_key"],
                  "log_id", how="inner")
    return rows.select("log_id", F.col("customer_name").alias("customer"), F.col("pages_billed"), "plan",
                       F.round(F.col("file_size_bytes") / 1024, 2).alias("file_size_kb"), "processing_time_ms")


def post_charges(log: DataFrame, users: DataFrame) -> DataFrame:
    """Users after charging their served requests: usage grows, prepaid credits shrink."""
    used = log.where(F.col("status_code") == 200).groupBy("api_key").agg(F.sum("pages_billed").alias("used"))
    j = users.join(used, "api_key", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return j.select(
        "api_key", "customer_name", "plan",
        F.when(F.col("plan") == "prepaid", F.col("credits_remaining") - F.col("used"))
        .otherwise(F.col("credits_remaining")).alias("credits_remaining"),
        (F.col("pages_processed_this_month") + F.col("used")).alias("pages_processed_this_month"))


def monthly_pages(log: DataFrame) -> DataFrame:
    """Pages per key and calendar month: the counter that starts over each month."""
    return log.where(F.col("status_code") == 200).groupBy("api_key", F.date_trunc("month", "created_at").cast("date")
                                                          .alias("month")).agg(F.sum("pages_billed").alias("pages"))


# ------------------------------------------------------------------ credit admission

def admit(requests: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Accept requests in time order while the key's credits last; rejected requests use nothing.

    requests: api_key, log_id, created_at, need, charge, credits. Keys of at most
    `fold_limit` requests are folded in one row each. Busier keys go through
    rounds: a running sum finds each key's first rejection; everything before it
    is accepted; from then on any request needing more than what is left can never
    be served and leaves. Every round removes at least one distinct need, so the
    rounds end, and each round is a block scan that splits a busy key over tasks.
    """
    requests = staged(requests, "requests")
    sizes = requests.groupBy("api_key").agg(F.count("*").alias("n_req"))
    sized = attach(requests, sizes, ["api_key"], "log_id")
    cold = sized.where(F.col("n_req") <= fold_limit)
    per_key = cold.groupBy("api_key").agg(
        F.max("credits").alias("credits"),
        F.array_sort(F.collect_list(F.struct("created_at", "log_id", "need", "charge"))).alias("reqs"))
    start = F.struct(F.col("credits").cast("bigint").alias("left"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc, r):
        yes = acc["left"] >= r["need"]
        return F.struct((acc["left"] - F.when(yes, r["charge"]).otherwise(F.lit(0))).cast("bigint").alias("left"),
                        F.array_append(acc["ok"], yes).alias("ok"))

    folded = per_key.withColumn("ok", F.aggregate("reqs", start, step)["ok"])
    served = folded.select("api_key", F.explode(F.arrays_zip("reqs", "ok")).alias("z")).select(
        "api_key", F.col("z.reqs.log_id").alias("log_id"), F.col("z.ok").alias("accepted"))
    hot_keys = sizes.where(F.col("n_req") > fold_limit)
    if hot_keys.isEmpty():
        return served
    return served.unionByName(_admit_in_rounds(sized.where(F.col("n_req") > fold_limit).drop("n_req")))


def _admit_in_rounds(requests: DataFrame) -> DataFrame:
    everyone = requests
    cand = cut(requests.withColumns({"at": F.unix_micros("created_at"), "left": F.col("credits").cast("bigint")})
               .where(F.col("need") <= F.col("left")))
    accepted = None
    while True:
        run = scan(cand, ["api_key"], "at", sums={"spent": "charge"}, tie="log_id")
        over = (F.col("spent") - F.col("charge") + F.col("need")) > F.col("left")
        stop = run.groupBy("api_key").agg(F.min(F.when(over, F.struct("at", "log_id"))).alias("stop"))
        run = cut(attach(run, stop, ["api_key"], "log_id"))
        before = F.col("stop").isNull() | (F.struct("at", "log_id") < F.col("stop"))
        won = run.where(before).select("api_key", "log_id")
        accepted = won if accepted is None else accepted.unionByName(won)
        spent = run.where(before & F.col("stop").isNotNull()).groupBy("api_key").agg(F.sum("charge").alias("used"))
        rest = attach(run.where(F.struct("at", "log_id") > F.col("stop")), spent, ["api_key"], "log_id")
        rest = rest.withColumn("left", F.col("left") - F.coalesce("used", F.lit(0)))
        cand = cut(rest.where(F.col("need") <= F.col("left")).drop("spent", "stop", "used"))
        if cand.isEmpty():
            break
    marks = accepted.withColumn("accepted", F.lit(True))
    return everyone.select("api_key", "log_id").join(marks.hint("merge"), ["api_key", "log_id"], "left") \
        .withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def request_outcomes(requests: DataFrame, users: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Status code of each request: 401 unknown key, 413 too large, 400 unsupported, 402 credits, 500 crash, 200.

    requests: log_id, api_key, created_at, file_size_bytes, pages (0 = unsupported), crashes.
    """
    known = attach(requests, users.select("api_key", "plan", "credits_remaining"), ["api_key"], "log_id")
    gate = (F.when(F.col("plan").isNull(), 401).when(F.col("file_size_bytes") > MAX_BYTES, 413)
            .when(F.col("pages") == 0, 400))
    known = known.withColumn("gate", gate)
    asks = known.where(F.col("gate").isNull() & (F.col("plan") == "prepaid")).select(
        "api_key", "log_id", "created_at", F.col("pages").cast("bigint").alias("need"),
        F.when(F.col("crashes"), 0).otherwise(F.col("pages")).cast("bigint").alias("charge"),
        F.col("credits_remaining").alias("credits"))
    served = admit(asks, fold_limit).select("log_id", "accepted")
    j = known.join(served.hint("merge"), "log_id", "left")
    code = F.coalesce("gate", F.when(F.col("accepted") == F.lit(False), 402).when(F.col("crashes"), 500).otherwise(200))
    return j.select("log_id", "api_key", F.col("pages"), code.cast("int").alias("status_code"))


# ------------------------------------------------------------------ limits and retention

def rate_limited(log: DataFrame, limit: int = RATE_LIMIT, window: str = RATE_WINDOW) -> DataFrame:
    """Keys and windows with more requests than allowed."""
    n = log.groupBy("api_key", F.window("created_at", window).alias("w")).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > limit).select("api_key", F.col("w.start").alias("window_start"), "n",
                                              (F.col("n") - limit).alias("over"))


def expired(entries: DataFrame, asof: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """Entries older than the retention time."""
    return entries.where(F.col("created_at") < asof - F.make_dt_interval(hours=F.lit(hours)))


# ------------------------------------------------------------------ changes

def add_customers(users: DataFrame, new: DataFrame) -> DataFrame:
    """Users plus the new ones whose name is free; new holds api_key, customer_name, plan, credits_remaining."""
    once = first_rows(new, ["customer_name"], ["api_key"], 1)  # a name enters once, with its least key
    fresh = once.join(users.select("customer_name"), "customer_name", "left_anti") \
        .withColumn("pages_processed_this_month", F.lit(0).cast("bigint"))
    return users.unionByName(fresh.select(*users.columns))


def approve_leads(leads: DataFrame, names: DataFrame) -> DataFrame:
    """Leads of the named companies become approved. names: customer_name."""
    hit = names.select(F.col("customer_name").alias("company_name")).distinct().withColumn("hit", F.lit(True))
    return leads.join(hit, "company_name", "left").withColumn(
        "status", F.when(F.col("hit"), "Approved").otherwise(F.col("status"))).drop("hit").select(*leads.columns)


def update_customers(users: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """New plan and credits by key. changes: api_key, plan, credits_remaining.

    Of several changes of a key the last in `order` holds; without an order the greatest (plan, credits), so the result is fixed.
    """
    at = F.col(order) if order else F.struct("plan", "credits_remaining")
    c = changes.groupBy("api_key").agg(F.max(F.struct(at.alias("at"), "plan", "credits_remaining")).alias("c")).select(
        "api_key", F.col("c.plan").alias("new_plan"), F.col("c.credits_remaining").alias("new_credits"))
    return users.join(c, "api_key", "left").withColumns({
        "plan": F.coalesce("new_plan", "plan"), "credits_remaining": F.coalesce("new_credits", "credits_remaining")}) \
        .select(*users.columns)


def not_found(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes whose key no user has."""
    return changes.join(users.select("api_key"), "api_key", "left_anti")


def rotate_keys(table: DataFrame, mapping: DataFrame, spread: str) -> DataFrame:
    """Replace old keys by new ones in a user table or a log. mapping: old_key, new_key."""
    m = mapping.groupBy(F.col("old_key").alias("api_key")).agg(F.max("new_key").alias("new_key"))  # one new key per old one
    return attach(table, m, ["api_key"], spread).withColumn("api_key", F.coalesce("new_key", "api_key")) \
        .select(*table.columns)
