"""Sources: folders, delimited and HTML exports, paged text; all end in the line model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.functions.common import col, strip
from ledgerlift.functions.text import billable_units, html_to_rows, join_cells, sniff_cells

# File types the bulk run accepts.
EXTENSIONS = ["pdf", "csv", "xlsx", "xls", "jpg", "jpeg", "png", "bmp", "tiff"]


def with_extension(df: DataFrame, path: str = "path") -> DataFrame:
    """File name and lower-case extension of a path column."""
    name = F.element_at(F.split(col(path), r"[/\\]"), -1)
    return df.withColumns({"file_name": name, "extension": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))})


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files below a folder: path, size, modification time. File contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select("path", "length", "modificationTime"))
    return with_extension(files).where(F.col("extension").isin(*EXTENSIONS))


def read_paged_text(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Page text files (pages separated by form feeds), one document per file."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
           .load(folder))
    docs = with_extension(raw).select(
        F.col("path").alias("doc_id"), F.col("file_name").alias("source_file"),
        F.decode("content", "UTF-8").alias("text"))
    return docs


def read_delimited(spark: SparkSession, folder: str, drop_empty: bool = True) -> DataFrame:
    """Delimited exports as tab text lines: one row per record, numbered within the file by byte order."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
             .load(folder))
    docs = files.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
    return delimited_lines(docs, drop_empty=drop_empty)


def delimited_lines(docs: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Delimited text to lines: delimiter by document, cells trimmed, empty cells and rows dropped."""
    row = F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "raw")
    marked = docs.withColumn("_tabs", F.col("text").contains("\t"))
    return (
        marked.select("doc_id", "_tabs", row)
        .select("doc_id", F.lit(0).alias("page_no"), F.col("line_no").cast("bigint").alias("line_no"),
                join_cells(sniff_cells("raw", F.when(F.col("_tabs"), "\t").otherwise(",")), drop_empty).alias("text"))
        .where(F.col("text") != "")
    )


def document_lines(docs: DataFrame) -> DataFrame:
    """Documents to lines. Pages split at form feeds; line numbers run through the whole document."""
    text = F.regexp_replace("text", r"\(cid:\s*12\)", "\n")
    pages = F.transform(F.split(text, "\f"), lambda p, i: F.transform(
        F.split(p, "\n"), lambda t: F.struct(i.alias("page_no"), t.alias("text"))))
    return (
        docs.select("doc_id", F.posexplode(F.flatten(pages)).alias("line_no", "l"))
        .select("doc_id", F.col("l.page_no").cast("int").alias("page_no"),
                F.col("line_no").cast("bigint").alias("line_no"), F.col("l.text").alias("text"))
    )


def html_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """HTML exports to tab text lines."""
    return pages.select(
        F.col(key).cast("string").alias("doc_id"), F.lit(0).alias("page_no"),
        F.posexplode(html_to_rows(html)).alias("line_no", "text"),
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def billed_documents(docs: DataFrame) -> DataFrame:
    """Billed pages per document from its extension, page count and line count."""
    t = F.col("text")
    pages = F.regexp_count(t, F.lit("\f")) + 1
    rows = F.regexp_count(strip(t), F.lit("\n")) + 1
    return docs.withColumn("pages_billed", billable_units("extension", pages, rows))


def read_table(spark: SparkSession, name: str, *, jdbc_url: str | None = None, folder: str | None = None,
               partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 64) -> DataFrame:
    """A metering table: parquet below a folder, or a partitioned JDBC read in production."""
    if jdbc_url is None:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    reader = spark.read.format("jdbc").option("url", jdbc_url).option("dbtable", name)
    if partition_column and bounds:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", partitions))
    return reader.load()
