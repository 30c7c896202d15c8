"""What the operators share: reading tables, tables kept in the shared folder, workers' import path."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BLANKS = " \t\n\x0b\f\r"  # what separates words: \x20 and \x09-\x0D
FOLDERS = "ledgerlift.llm.shared"  # folders made for sessions that name none, by application id
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may do without that setting: it gets a new folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="ledgerlift-llm-")
    return _OWN[sc.applicationId]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a step as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As keep, in buckets by a key that later joins and groups on, so they read it without a shuffle."""
    spark = df.sparkSession
    named = f"ledgerlift_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{named}")
     .bucketBy(n, key).saveAsTable(named))
    return spark.table(named)


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when the session was started elsewhere (a cluster gets it by --py-files)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; none of null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t\\n\\x0B\\f\\r]+", -1))
