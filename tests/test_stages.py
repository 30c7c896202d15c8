"""Steps leave no files behind that nobody reads, move rows no more often than they must, and give the same rows."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlift.catalog import QUERIES
from ledgerlift.operators import extract_rows as R
from ledgerlift.operators import extract_tables as T
from ledgerlift.operators import joined_rows as J
from ledgerlift.operators import ordered
from ledgerlift.operators.ordered import KEY_ROWS, attach
from ledgerlift.session import CONF_CLEANUP, ensure_checkpoint_dir, released, staged
from ledgerlift.sources import sinks

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stages(spark) -> set:
    folder = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/stages"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_shuffle_files_leave_with_their_stage(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, set_to = files(), spark.conf.get(CONF_CLEANUP, None)
    out = staged(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")))
    assert not files() - before and out.count() == 700 and spark.conf.get(CONF_CLEANUP, None) == set_to


def test_stages_leave_unless_they_are_read(spark):
    a, b = staged(spark.range(5), "a"), staged(spark.range(7), "b")
    assert released(a.where("id > 1"), a, b).count() == 3
    assert not os.path.exists(b.stage_path.removeprefix("file:"))


@pytest.mark.parametrize("name", ["itemised_register", "customer_products"])
def test_lines_of_a_register_leave_when_its_rows_are_written(spark, name):
    before = stages(spark)
    df = QUERIES[name](spark, DATA)
    left = {s.rsplit("-", 1)[0] for s in stages(spark) - before}
    assert not left & {"lines", "read-lines", "scan-input"} and df.count() == 6000


def test_lone_rows_are_not_grouped(spark, monkeypatch):
    """Texts before a row, rows with one number, texts that nothing ends, and rows alone; against a walk over the lines."""
    rng = random.Random(5)
    monkeypatch.setattr(R, "table_marks", lambda kind: F.when(F.col("class") == "head", True))
    rows = []
    for doc in ("a", "b", None):
        for i in range(60):
            role = "stop" if i == 0 else rng.choice(["close", "close", "text", "stop", "skip"])
            rows += [(doc, i, f"{role}{i}{k}", role, "head" if i == 0 else "row") for k in range(rng.choice([1, 1, 1, 2]) if role == "close" else 1)]
    df = spark.createDataFrame(rows, "doc_id string, line_no long, t string, r string, class string").select(
        "*", F.col("t").alias("raw"), F.array("t").alias("nums"), F.col("t").alias("inline"), F.lit(1).alias("n"), F.lit(False).alias("dated"),
        F.lit(None).cast("string").alias("company"), F.lit(True).alias("opens"))
    got = {(r.doc_id, r.line_no): (r.t, r.pending) for r in R.islands(df, "SUMMARY", F.col("r")).collect()}
    want, waiting = {}, []
    for doc, i, t, role, _ in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if role == "text":
            waiting.append(t)
        elif role == "close":
            old = want.get((doc, i))
            want[doc, i] = (max(t, old[0]) if old else t, old[1] if old else " ".join(waiting))
        if role in ("close", "stop"):
            waiting = []
    assert got == want and len(want) > 40
    alone = R.islands(df, "SUMMARY", F.col("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in alone and "alone" in alone


def test_only_large_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 10)
    df = spark.range(3000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 60).cast("string"))).alias("k"), "id")
    sizes = df.groupBy("k").agg(F.count("*").alias(KEY_ROWS), F.max("id").alias("v"))
    plain = attach(df, sizes, ["k"], "id")
    assert "_salt" not in plan(plain)  # every key was repeated 16 times
    monkeypatch.setattr(ordered, "BLOCK", 1000)
    salted = attach(df, sizes, ["k"], "id")
    assert "_salt" in plan(salted) and salted.columns == plain.columns == ["k", "id", "v"]
    want = {r.k: r.v for r in sizes.collect()}
    for out in (plain, salted):
        rows = out.collect()
        assert len(rows) == 3000 and all(r.v == want[r.k] for r in rows)


def test_rows_of_a_nested_report_move_once(spark):
    items = spark.range(50).select((F.col("id") % 3).cast("string").alias("doc_id"), F.col("id").alias("line_no"), (F.col("id") % 2).cast("string").alias("area"),
                                   (F.col("id") % 5).cast("string").alias("store_name"), F.lit("").alias("store_location"),
                                   *[F.lit(None).cast("string").alias(c) for c in ("description", "brand", "dosage", "packing", "qty", "free", "rate", "amount", "percent")])
    nested = sinks.nest_report(items)
    assert plan(nested).count("Exchange hashpartitioning") == 1  # three before
    assert sum(len(s.Items) for r in nested.collect() for a in r.Areas for s in a.Stores) == 50


def test_reconciled_rows_are_joined_once(spark):
    df = QUERIES["grand_total_reconcile"](spark, DATA)
    assert "lineitem.parquet" not in plan(df)


def test_flat_rows_are_read_before_they_move(spark):
    df = T.flat_items(spark.createDataFrame([("d", i, f"1 TOWN\tC{i}\tMEDICALS\tHEPP FORT SYP\t10*10\t5\t1\t2.50\t12.50\tLUPIN") for i in range(3)], "doc_id string, line_no long, text string"))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\b(all2|all3|last_two|packs|shape)#", text)  # cells and amounts of a row were written and exchanged twice
    assert [(r.store_name, r.description, r.packing, r.qty, r.free, float(r.rate), float(r.amount)) for r in df.orderBy("line_no").collect()] \
        == [(f"C{i} MEDICALS", "HEPP FORT SYP", "10*10", 5, 1, 2.5, 12.5) for i in range(3)]


def test_page_totals_move_no_lines(spark):
    before = stages(spark)
    rows = [("d", p, 10 * p + i, t) for p in (1, 2) for i, t in enumerate([
        "GST NO : 29A", f"M/S SHOP{p} MEDICAL STORE INVOICE NO. : {p}", f"TOWN DATE : 0{p}/02/2003 NO OF CASES : 3", "M/S LATER STORE INVOICE NO. : 9", f"Sub total : {p}.50"])]
    df = T.paged_invoice_totals(spark.createDataFrame([*rows, ("e", 0, 0, "Sub total : 9.00")], "doc_id string, page_no int, line_no long, text string"))
    text = plan(df)
    assert "Window" not in text  # the lines of a page were brought together with their texts
    assert not any(s.startswith(("scan-input-", "scan-")) for s in stages(spark) - before)
    got = {r.doc_id: (float(r.grand_total), r.from_date, r.to_date, r.n_invoices) for r in df.collect()}
    assert got == {"d": (4.0, "01/02/2003", "02/02/2003", 2), "e": (0.0, None, None, 0)}


def test_what_follows_a_row_is_found_once(spark):
    lines = spark.createDataFrame([("1. 20 ALFA 3004 1.00 2.00 3.00 4.00 5.00 6.00 2. BETA", ""), ("3004 1 2 3 4 5 6", "")], "t string, ahead string")
    df = J._machine(lines).select("t", J._exits().alias("to"))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("filter(cuts#") <= 6  # once for each of nine states and twice in each before
    # nothing open: the next row waits for its end in the line behind; an open row ends in the second line
    assert [r.to[0] for r in df.collect()] == ["7", "0"] and [r.to[7] for r in df.collect()][1] == "0"
