"""Metering tables derived from the event and customer tables: request log, users and leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_log(events: DataFrame) -> DataFrame:
    """Events as the request log: errors are failed requests, everything else a success."""
    eid = F.col("event_id")
    failed = F.col("event_type") == "error"
    code = F.when(~failed, 200).when(eid % 4 == 0, 402).when(eid % 4 == 1, 400).when(eid % 4 == 2, 413).otherwise(500)
    ext = F.when(eid % 3 == 0, "pdf").when(eid % 3 == 1, "csv").otherwise("png")
    name = F.concat(F.lit("report_"), eid.cast("string"), F.lit("."), ext)
    df = events.select(
        eid.alias("log_id"), F.col("user_id").cast("string").alias("api_key"), F.lit("/api/v1/extract").alias("endpoint"),
        name.alias("file_name"), (F.floor("value").cast("bigint") % 10 + 1).alias("pages_billed"),
        code.cast("int").alias("status_code"), F.floor(F.col("value") * 10).cast("bigint").alias("processing_time_ms"),
        F.col("ts").alias("created_at"), F.concat(F.lit("store/"), name).alias("file_url"),
        ((eid * 7919) % 20_000_000).alias("file_size_bytes"))
    return df.withColumns({
        "error_message": F.when(F.col("status_code") == 402, F.concat(
            F.lit("Insufficient credits. Requires "), F.col("pages_billed").cast("string"), F.lit(" pages.")))
        .when(F.col("status_code") != 200, F.concat(F.lit("failed "), F.col("file_name"))).otherwise(""),
        "quarantine_path": F.when(F.col("status_code") == 500, F.concat(F.lit("vault\\crash_"), F.col("file_name")))})


def users(customer: DataFrame) -> DataFrame:
    """Customers as API users; two market segments prepay."""
    return customer.select(
        F.col("c_custkey").cast("string").alias("api_key"), F.col("c_name").alias("customer_name"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "prepaid").otherwise("pay_as_you_go")
        .alias("plan"),
        F.greatest(F.floor(F.col("c_acctbal") / 40), F.lit(0)).cast("bigint").alias("credits_remaining"),
        (F.col("c_custkey") % 7).cast("bigint").alias("pages_processed_this_month"))


def leads(supplier: DataFrame) -> DataFrame:
    """Suppliers as leads; every third one was approved."""
    return supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("company_name"),
        F.concat(F.lit("lead"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("s_suppkey") % 28).cast("int")).alias("requested_at"),
        F.when(F.col("s_suppkey") % 3 == 0, "Approved").otherwise("Pending").alias("status"))
