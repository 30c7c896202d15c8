"""Files as they were received: every one is a row, also those that cannot be read, with the reason.

`received` turns files (path, length, content, as Spark's binary source gives them) into documents; `receive_folder` reads them from a
folder. What is wrong with a file never ends the job: its row carries an error, which the run summary shows as the document's status.

| error | meaning |
|---|---|
| missing | it was asked for, but no such file was found, or one without a byte (Spark's file listing leaves those out) |
| unreadable | it was found, but has no content or is no UTF-8 text |
| changed while read | its content has another length than its listing |

Empty contents of a table of files are read: no characters, no error. From a folder they are missing if asked for, else no row. Rows that repeat a path are one document (the least content stays). A
null path is no file and is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.sources.lines import discover, with_extension


def received(files: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """One row per file and per requested path (column `path`): doc_id, source_file, extension, n_chars, error, text.

    Texts of faulty files are null. Requested paths are joined by path; without them only files that were found are rows.
    """
    found = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.min(F.struct("length", "content")).alias("f")).select("path", "f.*", F.lit(True).alias("there"))
    if requested is not None:
        found = requested.select("path").where(F.col("path").isNotNull()).distinct().join(found, "path", "full")
    text = F.col("content").cast("string")
    error = (F.when(F.col("there").isNull(), "missing")
             .when(F.col("content").isNull(), "unreadable")
             .when(F.octet_length("content") != F.col("length"), "changed while read")
             .when(~F.is_valid_utf8(text), "unreadable"))
    named = with_extension(found.withColumn("error", error)).withColumn("text", F.when(F.col("error").isNull(), text))
    return named.select(F.col("path").alias("doc_id"), F.col("file_name").alias("source_file"), "extension",
                        F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), "error", "text")


def receive_folder(spark: SparkSession, folder: str, requested: DataFrame | None = None) -> DataFrame:
    """The supported files below a folder, as `received` gives them. Files that go or break while they are read do not end the job."""
    contents = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
                .option("ignoreMissingFiles", "true").load(folder).select("path", "content"))
    return received(discover(spark, folder).select("path", "length").join(contents, "path", "left"), requested)
