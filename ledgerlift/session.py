"""Session settings and the shared folder for checkpoints and stages.

Nothing here overrides what a cluster already sets: the builder is for local
runs and tests. A session that names no folder gets one of its own only when it
runs on one machine; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONF_CHECKPOINT = "spark.checkpoint.dir"
CONF_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = "*", name: str = "ledgerlift") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoint() and stages; the session's own setting wins."""
    sc = spark.sparkContext
    named = spark.conf.get(CONF_CHECKPOINT, None) or sc.getConf().get(CONF_CHECKPOINT, None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named and not sc.master.startswith("local"):
        raise ValueError(f"set {CONF_CHECKPOINT} to a folder that the driver and all executors share")
    folder = named or tempfile.mkdtemp(prefix="ledgerlift-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a step as a table in the shared folder and read it back: compressed, survives executor loss, read by many branches."""
    spark = df.sparkSession
    typed = df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if f.dataType.typeName() == "void"})
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        typed.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(typed.schema).parquet(path)
    out.stage_path = path
    return out


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Shuffle files of the jobs inside leave with the job: what it wrote is all that is read later."""
    before = spark.conf.get(CONF_CLEANUP, None)
    spark.conf.set(CONF_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CONF_CLEANUP)
        else:
            spark.conf.set(CONF_CLEANUP, before)


def released(df: DataFrame, *stages: DataFrame) -> DataFrame:
    """`df`; the files of those given stages that it does not read leave the shared folder. Nobody else may read them."""
    paths = [s.stage_path for s in stages if getattr(s, "stage_path", None)]
    read = df.inputFiles() if paths else []
    for path in paths:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in read):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    return df


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, drops the lineage of an iterative job."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
