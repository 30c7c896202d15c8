"""The store of learned layouts: whole versions beside each other, the greatest complete one counts.

A version holds every key once, with the number of rows it should have; one whose rows are not all there is passed over. Each writer
uses a folder of its own, so nothing is overwritten: readers see the old version or the new one. Of two writers that start from the
same version the least folder name counts; what the other found is found again by its next run. A run whose keys are all
known writes nothing, so a replay leaves the store as it is.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.operators.detect import newly_learned
from ledgerlift.session import staged

SCHEMA = "key string, format_id string, confidence double, n_rows long, version long, run string"


def _versions(spark: SparkSession, folder: str) -> DataFrame | None:
    """All rows of all versions; nothing if the store does not exist."""
    try:
        return spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _current(rows: DataFrame | None) -> tuple[int, str] | None:
    """Version and run that count: one row, however many layouts are known."""
    if rows is None:
        return None
    whole = rows.groupBy("version", "run").agg(F.count("*").alias("n"), F.max("n_rows").alias("n_rows")).where("n = n_rows")
    found = whole.orderBy(F.desc("version"), "run").limit(1).collect()
    return (found[0]["version"], found[0]["run"]) if found else None


def read_learned(spark: SparkSession, folder: str) -> DataFrame | None:
    """key, format_id and confidence of the layouts learned so far; nothing before the first run."""
    rows = _versions(spark, folder)
    now = _current(rows)
    return None if now is None else rows.where((F.col("version") == now[0]) & (F.col("run") == now[1])).select("key", "format_id", "confidence")


def remember(spark: SparkSession, folder: str, inferred: DataFrame) -> int:
    """Add the layouts that the columns of this run's documents showed; a known key keeps its layout. Returns how many are new."""
    rows = _versions(spark, folder)
    now = _current(rows)
    known = read_learned(spark, folder)
    new = staged(newly_learned(inferred, known), "newly-learned")
    n_new = new.count()
    if n_new:
        every = staged(new if known is None else known.unionByName(new), "learned")
        version = 1 if now is None else now[0] + 1
        every.withColumn("n_rows", F.lit(every.count()).cast("long")).write.mode("errorifexists").parquet(
            f"{folder.rstrip('/')}/version={version}/run={uuid.uuid4().hex}")
    return n_new
