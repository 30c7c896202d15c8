"""Documents through quality rules, near copies, benchmark leaks, mixing and token output.

run(spark, sf_dir) applies STAGES to the documents table. Each stage takes (spark, docs, sf_dir); what it returns is written as
Parquet in the shared folder and read again as the next one's documents. All but the last return the columns of documents.

1. quality_rules: rejected documents go.
2. jaccard_join: of each group of near copies (shingles of 5 words, similarity 0.8) the least doc_id stays, as do rows without a doc_id.
3. decontamination: documents that hold a benchmark item go.
4. mixing: documents are sampled towards the target weights. Sampling is its task, so clean documents go here too.
5. token_output: what is left is written as wavelet shards; per document its place, length and checksum as read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.llm import catalog, jaccard, mixing, quality, templates, wavelet
from ledgerlift.llm.common import keep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs).filter("kept").select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.jaccard_components(docs, width=5, percent=80)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs, catalog.TARGETS, catalog.SHARE, catalog.TOKENIZER).filter("taken").select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wavelet.written_and_read(docs, catalog.TOKENIZER, catalog.END_ID)


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("mixing", mixed),
          ("token_output", token_output)]
ORACLE_SQL = None  # SQL cannot express the stages; tests/llm compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"stage-{name}")
    return docs
