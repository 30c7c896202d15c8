"""Token counts of whole texts by the compiled transducers (transducers.py), one pass without a shuffle.

The tokenizer is a byte-level BPE file of the tokenizers library, given by its path on the workers; counts are as the library gives
them without begin and end tokens, and added tokens inside a text count one, as is its default. A null text is empty: no bytes, no
tokens. Rows are counted one by one; repeated rows and ids repeat. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import on_workers
from ledgerlift.llm.transducers import compiled


def token_counts(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than the limit)."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for rb in batches:
            texts = [t or "" for t in rb.column(1).to_pylist()]
            n = machine.count(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": rb.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                "over_limit": [x > limit for x in n]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
