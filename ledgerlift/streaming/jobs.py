"""Stream jobs over the request log and a report folder.

Outputs go through foreachBatch into one folder per batch, overwritten when a
batch is replayed, so a restart after a lost executor or driver writes nothing
twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlift.operators.usage import RATE_LIMIT, RATE_WINDOW


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The parquet files of one table, a file or a folder of part files, as a stream; the schema is taken from the files present."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if all(f.rstrip("/").endswith(f"/{name}.parquet") for f in table.inputFiles()):  # a stream's source must be a folder
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def read_report_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New text files of a folder as documents: doc_id is the path, pages stay separated by form feeds."""
    return (spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
            .select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                  transform: Callable[[DataFrame], DataFrame] | None = None):
    """Start the stream on what is available now; each batch lands in its own folder."""
    def land(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(land)
            .trigger(availableNow=True).start())


def latest_per_key(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest batch's row of each key: the reading side of update-mode outputs."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def live_kpis(log: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Requests, errors, pages and latency per time window."""
    w = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    ok = F.col("status_code") == 200
    return log.withWatermark("created_at", late).groupBy(w.alias("w")).agg(
        F.count("*").alias("requests"), F.count(F.when(F.col("status_code") > 399, 1)).alias("errors"),
        F.sum("pages_billed").alias("pages"), F.avg(F.when(ok, F.col("processing_time_ms"))).alias("avg_latency")) \
        .select(F.col("w.start").alias("window_start"), "requests", "errors", "pages", "avg_latency")


def live_rate_alerts(log: DataFrame, limit: int = RATE_LIMIT, window: str = RATE_WINDOW, late: str = "10 minutes") -> DataFrame:
    """Keys over the limit in a tumbling window; rows later than the watermark are left out."""
    return log.withWatermark("created_at", late).groupBy("api_key", F.window("created_at", window).alias("w")).agg(
        F.count("*").alias("n")).where(F.col("n") > limit).select("api_key", F.col("w.start").alias("window_start"), "n")


def live_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions per key; a session comes out once the watermark has passed its end."""
    return log.withWatermark("created_at", late).groupBy("api_key", F.session_window("created_at", gap).alias("s")).agg(
        F.count("*").alias("requests"), F.sum("pages_billed").alias("pages")) \
        .select("api_key", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "requests", "pages")


_ADMITTED = "api_key string, log_id long, accepted boolean"


def _decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Serve one key's requests of a batch in time order against the credits left in the state."""
    batch = pd.concat(list(frames)).sort_values(["created_at", "log_id"])
    left = state.get[0] if state.exists else int(batch["credits"].iloc[0])
    verdicts = []
    for need, charge in zip(batch["need"], batch["charge"]):
        served = left >= need
        left -= int(charge) if served else 0
        verdicts.append(served)
    state.update((left,))
    yield pd.DataFrame({"api_key": key[0], "log_id": batch["log_id"], "accepted": verdicts})


def live_admission(requests: DataFrame) -> DataFrame:
    """Credit admission with the remaining credits kept as state per key.

    requests: api_key, log_id, created_at, need, charge (0 if the request crashes), credits. A key's rows of one micro-batch are
    handled together; `files_per_batch` of the source bounds them. Order holds within a batch and between batches as they arrive.
    """
    return requests.groupBy("api_key").applyInPandasWithState(
        _decide, outputStructType=_ADMITTED, stateStructType="left long", outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout)
