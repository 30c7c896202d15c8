"""Waiting text that is flushed, against a line-by-line fold; runs longer than a chunk."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlift.operators import extract_rows as R
from ledgerlift.plans.pipeline import process


def folded(rows, flush):
    """(doc_id, line_no, text, flushed): what waited before each closing line, and what was flushed."""
    out, docs = [], {}
    for doc, line, text, role in rows:
        docs.setdefault(doc, []).append((line, text, role))
    for doc, lines in docs.items():
        waits, last = "", None
        for line, text, role in sorted(lines)[1:]:  # the first opens the table
            if role == "text":
                if len(waits) > flush and len(text) > 3:
                    out.append((doc, last, waits, True))
                    waits = text
                else:
                    waits = f"{waits} {text}".strip()
                last = line
            else:
                if role == "close":
                    out.append((doc, line, waits, False))
                waits = ""
    return sorted(out)


def annotated(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, line_no long, t string, kind string")
    same = {c: F.col("t") for c in ("raw", "inline")} | {c: F.array("t") for c in ("toks", "nums", "words")}
    return df.withColumns({**same, "n": F.lit(1), "dated": F.lit(False), "class": F.lit("row"), "trade": F.lit(False), "company": F.lit(""), "opens": F.lit(True)})


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", "line_no", "pending", "flushed").collect())


@pytest.mark.parametrize("chunk", [R.CHUNK_CHARS, 300])
def test_equals_a_fold_line_by_line(spark, chunk):
    rnd = random.Random(3)
    shares = [[.9, .08, .02], [.995, .005, 0], [1, 0, 0], [.5, .4, .1], [.99, 0, .01]]
    rows = [(str(d), 3 * k, "".join(rnd.choices("abcdefg", k=rnd.choice([1, 2, 3, 5, 20, 41, 41, 90]))), rnd.choices(["text", "close", "stop"], shares[d])[0])
            for d in range(5) for k in range(300)]
    got = rows_of(R.flushed_islands(annotated(spark, rows), "SUMMARY", F.col("kind"), {"own": F.col("t")}, 80, chunk))
    assert got == folded(rows, 80) and any(r[3] for r in got)


def test_a_run_of_many_lines_is_cut_into_chunks(spark):
    rows = [("a", k, f"line number {k} of the waiting text", "text") for k in range(100_000)] + [("a", 100_000, "end", "close")]
    out = R.flushed_islands(annotated(spark, rows), "SUMMARY", F.col("kind"))
    assert rows_of(out) == folded(rows, 80)


def test_the_pipeline_flushes(spark):
    waiting = ["FIRST LONG LINE OF A STORE NAME THAT RUNS OVER", "ITS END AND MORE WORDS BEHIND IT MEDICAL STORE", "RAVI MEDICAL STORE, TOWN 10.50"]
    texts = ["SHARMA TRADERS", "SUMMARY REPORT", "STORENAME STORE LOCATION SALES RETURN AMOUNT", *waiting, "GRAND TOTAL 10.50"]
    lines = spark.createDataFrame([("d", 0, k, t) for k, t in enumerate(texts)], "doc_id string, page_no int, line_no long, text string")
    extra = spark.createDataFrame([("d", 0, 3, "ANOTHER LONG LINE IN FRONT OF THE STORE NAME")], lines.schema)
    shifted = lines.where("line_no < 3").union(extra).union(lines.where("line_no >= 3").withColumn("line_no", F.col("line_no") + 1))
    items = process(shifted)["items"].collect()
    assert sorted(float(r.amount) for r in items) == [0.0, 10.5]
