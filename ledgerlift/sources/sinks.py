"""Sinks: nested JSON, the flat fact table, the QA table, the run summary and side outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift import schemas


def write_fact(fact: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = fact.select(*[f"`{f.name}`" for f in schemas.FACT.fields]).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def append_qa(qa: DataFrame, path: str) -> None:
    qa.select(*[f"`{f.name}`" for f in schemas.QA.fields]).write.mode("append").option("header", True).csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.select(*[f"`{f.name}`" for f in schemas.SUMMARY.fields]).write.mode("overwrite").option("header", True) \
        .csv(path)


def store_documents(fact: DataFrame) -> DataFrame:
    """Rows nested into (file, area, store) documents: the unit of the JSON sink.

    A store, not a whole report, is one JSON record; `nest_report` gives the three-level form, one record per report, which must
    fit a row.
    """
    item = F.struct(
        F.col("line_no"), F.col("description").alias("Description"), F.col("brand").alias("Brand_Name"),
        F.col("dosage").alias("Dosage"), F.col("packing").alias("Packaging"), F.col("qty").alias("Qty"),
        F.col("free").alias("Free"), F.col("rate").alias("Rate"), F.col("amount").alias("Amount"),
        F.col("percent").alias("Percent"))
    return (
        fact.groupBy("doc_id", "area", "store_name", "store_location")
        .agg(F.array_sort(F.collect_list(item)).alias("Items"))
    )


def nest_report(fact: DataFrame) -> DataFrame:
    """Report documents Areas > Stores > Items, for reports whose rows fit one record; the caller checks their number."""
    stores = store_documents(fact.repartition("doc_id"))  # the record is one row; rows move to it once, not at each of the three levels
    areas = stores.groupBy("doc_id", "area").agg(F.array_sort(F.collect_list(F.struct(
        F.col("store_name").alias("StoreName"), F.col("store_location").alias("StoreLocation"), "Items")))
        .alias("Stores"))
    return areas.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("area").alias("AreaName"), "Stores"))).alias("Areas"))


def write_json(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").json(path)


def write_raw_text(lines: DataFrame, path: str) -> None:
    """The raw text of every document, one folder per page range of the corpus."""
    lines.select("doc_id", "page_no", "line_no", "text").write.mode("overwrite").parquet(path)


def investigation_lines(lines: DataFrame, item_counts: DataFrame, fallback: str = "LEGACY_UNIVERSAL_TWO_COLUMN") \
        -> DataFrame:
    """Lines of documents without items or routed to the fallback layout, with the reason.

    item_counts holds doc_id, detected_format and n_items, one row per document.
    """
    odd = item_counts.select("doc_id", F.when(F.coalesce("n_items", F.lit(0)) == 0, "no items")
                             .when(F.col("detected_format") == fallback, "fallback layout").alias("reason")) \
        .where(F.col("reason").isNotNull())
    return lines.join(odd, "doc_id")


def write_investigation(dump: DataFrame, path: str) -> None:
    dump.write.mode("overwrite").partitionBy("reason").parquet(path)


def write_with_flagged(rows: DataFrame, all_path: str, flagged_path: str) -> None:
    """All rows and, beside them, only the flagged ones; flags joined by '; '."""
    shown = rows.withColumn("QA Flags", F.concat_ws("; ", "flags"))
    shown.drop("flags").write.mode("overwrite").option("header", True).csv(all_path)
    shown.where(F.size("flags") > 0).drop("flags").write.mode("overwrite").option("header", True).csv(flagged_path)
