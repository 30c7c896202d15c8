"""Totals, reconciliation, flags, quality and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.registry import SALES, SHOPS, TOTALS, plain, query
from ledgerlift.functions.common import money
from ledgerlift.operators import extract_tables as T
from ledgerlift.operators import postprocess as P
from ledgerlift.operators import reconcile as R
from ledgerlift.operators.extract_rows import as_items
from ledgerlift.plans import pipeline
from ledgerlift.session import staged
from ledgerlift.sources import render, sinks
from ledgerlift.sources.lines import document_lines
from ledgerlift.sources.received import received

_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"


def _formats(spark, d):
    return render.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"),
                                                     F.lit("BUSY_PARTY_PRODUCT_WISE").alias("format_id"))


@query("statement_verdicts", "A1 A10 A11 X3 S10 D11", f"""WITH t AS (SELECT l_suppkey, sum({_PRICE}) AS s FROM lineitem GROUP BY 1)
SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, 'Perfect Match' AS status, CAST(s AS DOUBLE) AS actual, CAST(s AS DOUBLE) AS extracted, 0.0::DOUBLE AS gap,
  'Values matching' AS remarks FROM t""")
def statement_verdicts(spark, d):
    """Per statement: rows read back, compared with the printed grand total."""
    lines = render.delimited_statement(spark, d)
    items = T.delimited_items(lines, _formats(spark, d))
    docs = items.groupBy("doc_id").agg(F.first("doc_id").alias("source_file")).withColumns(
        {"extension": F.lit("txt"), "n_chars": F.lit(0), "error": F.lit(None).cast("string")})
    s = R.run_summary(docs, R.written_totals(items), R.expected_total(lines))
    return plain(s.select("doc_id", F.col("Status").alias("status"), F.col("Actual Amount").alias("actual"), F.col("CSV Amount").alias("extracted"),
                          F.col("Missing Gap Amount").alias("gap"), F.col("Remarks").alias("remarks")))


def order_files(spark, d):
    """A printed statement per order as files (path, length, content), and the paths asked for. By order number: not delivered, no UTF-8,
    longer in the listing, a PDF without rows, no total, a wrong total, in order."""
    kind, total = F.col("l_orderkey") % 7, F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    row = F.concat_ws("\t", F.lit("SHOP, PLACE"), F.concat(F.lit("ITEM "), render.lettered(F.col("l_partkey").cast("string"))), F.lit("1*2"),
                      render.whole_text("l_quantity"), F.lit("0"), F.lit("1.00"), render.amount_text("l_extendedprice"), F.lit("0.00"), F.lit("0.00"))
    # an order has a few lines, so its file is a row
    orders = render.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("rows"), total.alias("total"))
    printed = F.concat(F.lit("GRAND TOTAL\t"), (F.col("total") + F.when(kind == 5, 10).otherwise(0)).cast("decimal(18,2)").cast("string"))
    head = F.array(F.lit("BUSY ACCOUNTS"), F.lit("NORTH TRADERS"), F.lit("PARTY WISE PRODUCT WISE SALES"),
                   F.lit("PARTY NAME\tPRODUCT\tPACKING\tQTY\tFREE\tRATE\tAMOUNT\tDISCOUNT\tTAX"))
    scanned = F.array(*[F.lit("A PAGE THAT ONLY HAS WORDS AND NO ROWS OF ANY TABLE")] * 4)
    body = F.when(kind == 3, scanned).when(kind == 4, F.concat(head, F.col("rows.row"))).otherwise(F.concat(head, F.col("rows.row"), F.array(printed)))
    content = F.concat(F.encode(F.array_join(body, "\n"), "UTF-8"), F.when(kind == 1, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit(""))))
    named = orders.select(F.concat(F.lit("in/"), F.col("l_orderkey").cast("string"), F.when(kind == 3, ".PDF").otherwise(".csv")).alias("path"), kind.alias("kind"),
                          content.alias("content"))
    files = named.where("kind <> 0").select("path", (F.octet_length("content") + F.when(F.col("kind") == 2, 1).otherwise(0)).cast("bigint").alias("length"), "content")
    return files, named.select("path")


@query("received_summary", "A11 S1 S10", f"""WITH t AS (SELECT l_orderkey AS k, sum({_PRICE}) AS s FROM lineitem GROUP BY 1),
u AS (SELECT k, k % 7 AS kind, CASE WHEN k % 7 = 6 THEN s WHEN k % 7 = 5 THEN s + 10 ELSE 0 END AS want, CASE WHEN k % 7 >= 4 THEN s ELSE 0 END AS got FROM t)
SELECT k || CASE WHEN kind = 3 THEN '.PDF' ELSE '.csv' END AS file_name,
  ['File Not Found', 'Extraction Error', 'Crash', 'UNSUPPORTED_FORMAT', 'Grand Total Not Found', 'Mismatch Detected', 'Perfect Match'][kind + 1] AS status,
  CAST(want AS DOUBLE) AS actual, CAST(got AS DOUBLE) AS extracted, CASE WHEN kind = 5 THEN 10.0 ELSE 0.0 END::DOUBLE AS gap,
  ['File does not exist', 'unreadable', 'changed while read', 'Native Text Extracted but Regex Failed', 'Unable to auto-verify Grand Total',
   'Check final amount / Gap found: 10.00', 'Values matching'][kind + 1] AS remarks FROM u""")
def received_summary(spark, d):
    """Per file asked for or received: one of seven verdicts; faulty files are rows from the source to the summary."""
    docs = received(*order_files(spark, d))
    lines = document_lines(docs.where(F.col("error").isNull()).select("doc_id", "text"))
    items = T.delimited_items(lines, docs.select("doc_id", F.lit("BUSY_PARTY_PRODUCT_WISE").alias("format_id")))
    s = R.run_summary(docs.drop("text"), R.written_totals(items), R.expected_total(lines))
    return plain(s.select(F.col("File Name").alias("file_name"), F.col("Status").alias("status"), F.col("Actual Amount").alias("actual"),
                          F.col("CSV Amount").alias("extracted"), F.col("Missing Gap Amount").alias("gap"), F.col("Remarks").alias("remarks")))


@query("document_statuses", "A11", """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, ['File Not Found', 'Extraction Error', 'Crash', 'UNSUPPORTED_FORMAT', 'Grand Total Not Found', 'Mismatch Detected', 'Perfect Match'][o_orderkey % 7 + 1] AS status,
  CASE WHEN o_orderkey % 7 = 5 THEN 1.0 WHEN o_orderkey % 7 = 6 THEN 0.99 ELSE 0.0 END::DOUBLE AS gap FROM orders""")
def document_statuses(spark, d):
    """Every verdict: orders stand for documents, their key decides what went wrong."""
    k = F.col("o_orderkey") % 7
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), "o_orderkey", money("o_totalprice").alias("total"))
    docs = o.select("doc_id", F.col("doc_id").alias("source_file"), F.when(k == 3, "pdf").otherwise("csv").alias("extension"), F.lit(200).alias("n_chars"),
                    F.when(k == 0, "missing").when(k == 1, "unreadable").when(k == 2, "boom").alias("error"))
    written = o.where(k >= 4).select("doc_id", F.col("total").alias("csv_amount"), F.lit(3).alias("n_rows"))
    expected = o.where(k >= 5).select("doc_id", money(F.col("total") + F.when(k == 5, 1).otherwise(F.lit(0.99).cast("decimal(18,2)"))).alias("expected_total"))
    return plain(R.run_summary(docs, written, expected).select("doc_id", F.col("Status").alias("status"), F.col("Missing Gap Amount").alias("gap")))


@query("expected_totals", "A1", f"WITH {TOTALS} SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, CAST(sum(total) AS DOUBLE) AS expected_total FROM totals GROUP BY 1")
def expected_totals(spark, d):
    return plain(R.expected_total(render.summary_report(spark, d)))


@query("document_totals", "A2", """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_totalprice <= 450000 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) ELSE 7.5 END AS grand_total FROM orders""")
def document_totals(spark, d):
    """A page line and an absurd number never become the total."""
    o = render.table(spark, d, "orders")
    p = money("o_totalprice")
    lines = render.lines_of(o, F.col("o_orderkey"), F.lit(0), F.lit("page total: 999999.00"), F.concat(F.lit("net amount "), F.when(
        F.col("o_totalprice") <= 450000, p).otherwise(p * 10).cast("decimal(18,2)").cast("string")), F.lit("total 7.50"))
    return plain(R.document_total(lines))


@query("nearby_totals", "A3 A4", """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) ELSE 4321.0 END AS grand_total,
  o_orderkey % 2 = 0 AS within FROM orders""")
def nearby_totals(spark, d):
    """The total stands on the line below its label; odd orders print only a whole number."""
    o = render.table(spark, d, "orders")
    body = F.when(F.col("o_orderkey") % 2 == 0, render.amount_text("o_totalprice")).otherwise("amount 4321")
    lines = render.lines_of(o, F.col("o_orderkey"), F.lit(0), F.lit("far 888888.88"), F.lit("more"), F.lit("Grand Total"), body, F.lit("x"), F.lit("777777.77"))
    j = R.nearby_total(lines).join(o.select(F.col("o_orderkey").cast("string").alias("doc_id"), money("o_totalprice").alias("own")), "doc_id")
    return plain(j.select("doc_id", "grand_total", R.within("own", "grand_total").alias("within")))


_LINES = f"""n AS (SELECT l.*, {_PRICE} AS amt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem l),
t AS (SELECT l_orderkey, sum(amt) AS total FROM n GROUP BY 1)"""


def _invoice_rows(spark, d):
    """Order lines as items; every third order carries its total as a last row, every fourth total is 1.50 off."""
    # read by the items, their totals and the printed totals: joined once
    s = staged(render.sales(spark, d).select("l_orderkey", "seq", "l_extendedprice", "l_quantity"), "sales")
    amt = money("l_extendedprice")
    items = s.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("seq").cast("bigint").alias("line_no"), F.lit("SHOP").alias("store_name"),
                     F.concat(F.lit("item "), F.col("seq").cast("string"), F.when(F.col("seq") % 5 == 0, " discount").otherwise("")).alias("description"),
                     amt.alias("amount"), F.col("l_quantity").alias("qty"), F.col("l_orderkey"))
    total = s.groupBy("l_orderkey").agg(F.sum(amt).alias("total"))
    last = total.where(F.col("l_orderkey") % 3 == 0).select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(1_000_000).cast("bigint").alias("line_no"), F.lit("SHOP").alias("store_name"),
        F.lit("all rows").alias("description"), F.col("total").alias("amount"), F.lit(0.0).alias("qty"), "l_orderkey")
    docs = total.select(F.col("l_orderkey").cast("string").alias("doc_id"), money(F.when(
        F.col("l_orderkey") % 4 == 0, F.col("total") + F.lit(1.5).cast("decimal(18,2)")).otherwise(F.col("total"))).alias("grand_total"),
        F.lit("SUMMARY").alias("report_type"), F.lit("01-01-2024").alias("from_date"),
        F.when(F.col("l_orderkey") % 5 == 0, "01-01-2024").otherwise("31-01-2024").alias("to_date"))
    return as_items(items.unionByName(last), "SUMMARY"), docs


@query("grand_total_reconcile", "A5 A6 A7 A8 A9 A10", f"""WITH {_LINES}, o AS (SELECT l_orderkey, total, CASE WHEN l_orderkey % 4 = 0 THEN total + 1.50 ELSE total END AS printed FROM t),
i AS (SELECT n.l_orderkey, seq, 'item ' || seq || CASE WHEN seq % 5 = 0 THEN ' discount' ELSE '' END AS d, amt, printed, total, l_orderkey % 5 = 0 AS invoice,
    row_number() OVER (PARTITION BY n.l_orderkey ORDER BY amt DESC, seq) AS r, row_number() OVER (PARTITION BY n.l_orderkey ORDER BY seq DESC) AS back,
    count(*) OVER (PARTITION BY n.l_orderkey) AS k FROM n JOIN o USING (l_orderkey)),
-- without an added total row the last line itself is tested against the others
z AS (SELECT *, (l_orderkey % 3 <> 0 AND k > 1 AND abs(max(CASE WHEN back = 1 THEN amt END) OVER (PARTITION BY l_orderkey) * 2 - total) <= 2) AS tail FROM i),
a AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 AND k = 1 THEN 0 ELSE 1 END AS x FROM z WHERE NOT (tail AND back = 1)),
f AS (SELECT l_orderkey, seq, invoice, amt + CASE WHEN r = 1 AND printed <> total AND NOT tail THEN printed - total ELSE 0 END AS amt, printed, k,
  d || CASE WHEN r = 1 AND printed <> total AND NOT tail THEN ' [ROUNDING ADJ]' ELSE '' END AS d FROM a)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, d AS description, CAST(amt AS DOUBLE) AS amount, CASE WHEN invoice THEN 'INVOICE' ELSE 'STATEMENT' END AS doc_type,
  CASE WHEN contains(d, 'discount') THEN CAST(amt AS DOUBLE) ELSE 0.0 END AS discount_amount FROM f
WHERE NOT (invoice AND contains(d, 'discount')) AND NOT (amt = printed AND k > 1)""")
def grand_total_reconcile(spark, d):
    items, docs = _invoice_rows(spark, d)
    return plain(R.output_rows(items, docs), "doc_id", "description", "amount", "doc_type", "discount_amount")


@query("item_counts", "A12", f"WITH {SALES} SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS n_areas, count(DISTINCT code || place) AS n_stores, count(*) AS n_items FROM sales GROUP BY 1")
def item_counts(spark, d):
    return R.item_counts(T.delimited_items(render.delimited_statement(spark, d), _formats(spark, d), party_as_store=True))


_FLAGGED = """q AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 1 THEN -l_extendedprice WHEN l_linenumber = 2 THEN l_extendedprice * 10 ELSE l_extendedprice END AS amt,
  CASE WHEN l_linenumber = 3 THEN 200000.0 ELSE 10.0 END AS rate, CASE WHEN l_linenumber = 4 THEN 0 ELSE l_quantity END AS q,
  CASE WHEN l_linenumber = 5 THEN 'ab' ELSE p_name END AS d FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _flag_rows(spark, d):
    li = render.table(spark, d, "lineitem").join(render.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_linenumber")
    p = F.col("l_extendedprice")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", money(F.when(k == 1, -p).when(k == 2, p * 10).otherwise(p)).alias("amount"),
                     F.when(k == 3, 200000.0).otherwise(10.0).alias("rate"), F.when(k == 4, 0).otherwise(F.col("l_quantity")).cast("bigint").alias("qty"),
                     F.lit(0).alias("free"), F.when(k == 5, "ab").otherwise(F.col("p_name")).alias("description"), F.lit("S1").alias("store_name"))


@query("row_flags", "Q1 D10", f"""WITH {_FLAGGED} SELECT l_orderkey, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN amt <= 0 THEN 'ZERO_AMOUNT' END,
  CASE WHEN amt > 0 AND rate > amt THEN 'RATE_EXCEEDS_AMOUNT' END, CASE WHEN length(d) < 4 THEN 'SHORT_DESC' END,
  CASE WHEN amt > 500000 THEN 'UNUSUALLY_LARGE_AMOUNT' END, CASE WHEN q = 0 AND amt > 0 THEN 'QTY_MISSING' END], lambda x: x IS NOT NULL), '|') AS qa_flags FROM q""")
def row_flags(spark, d):
    rows = _flag_rows(spark, d).withColumn("flags", P.row_flags())
    return P.flagged_text(rows).select("l_orderkey", "l_partkey", "l_suppkey", "qa_flags")


@query("extended_flags", "Q2", f"""WITH {_FLAGGED} SELECT l_orderkey, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN length(d) < 5 THEN 'OCR_VERY_LOW_CONFIDENCE' ELSE 'OCR_LOW_CONFIDENCE' END,
  CASE WHEN amt < 0 THEN 'NEGATIVE_AMOUNT' END, CASE WHEN q <= 0 THEN 'ZERO_QTY' END, CASE WHEN rate > 99999 THEN 'UNUSUALLY_HIGH_RATE' END, 'STORE_NAME_GARBLED'],
  lambda x: x IS NOT NULL), '; ') AS flags FROM q""")
def extended_flags(spark, d):
    """Prose-like names score 0.35 at most: no digits, no tabs; two letters score 0.10."""
    return _flag_rows(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", F.concat_ws("; ", P.extended_flags()).alias("flags"))


@query("flag_rollup", "Q7 S9", f"""WITH {_FLAGGED}, f AS (SELECT amt, unnest(CASE WHEN len(x) = 0 THEN ['CLEAN'] ELSE x END) AS flag FROM (SELECT CAST(amt AS DECIMAL(18,2)) AS amt, list_filter([CASE WHEN amt <= 0 THEN 'ZERO_AMOUNT' END,
  CASE WHEN amt > 0 AND rate > amt THEN 'RATE_EXCEEDS_AMOUNT' END, CASE WHEN length(d) < 4 THEN 'SHORT_DESC' END,
  CASE WHEN amt > 500000 THEN 'UNUSUALLY_LARGE_AMOUNT' END, CASE WHEN q = 0 AND amt > 0 THEN 'QTY_MISSING' END], lambda x: x IS NOT NULL) AS x FROM q))
SELECT k AS report_type, flag, count(*) AS n_rows, CAST(sum(amt) AS DOUBLE) AS amount FROM (SELECT *, 'SUMMARY' AS k FROM f) GROUP BY ROLLUP (k, flag)""")
def flag_rollup(spark, d):
    rows = _flag_rows(spark, d).withColumns({"flags": P.row_flags(), "report_type": F.lit("SUMMARY")})
    return plain(R.flag_rollup(rows))


@query("doc_quality", "Q6", f"""WITH {_FLAGGED}, s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (amt <= 0 OR rate > amt OR length(d) < 4 OR amt > 500000 OR q = 0) AS bad,
  sum(CAST(amt AS DECIMAL(18,2))) AS total, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS printed FROM q GROUP BY 1)
SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, n AS total_rows, bad AS flagged_rows, n - bad AS clean_rows, CAST(total AS DOUBLE) AS total_amount, round(CAST(total AS DOUBLE) / CAST(printed AS DOUBLE) * 100, 2) AS coverage_pct,
  bad = 0 AND CAST(total AS DOUBLE) / CAST(printed AS DOUBLE) * 100 >= 85 AS qa_pass FROM s""")
def doc_quality(spark, d):
    rows = _flag_rows(spark, d).withColumns({"doc_id": F.col("l_suppkey").cast("string"), "flags": P.row_flags()})
    docs = render.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("doc_id")).agg(
        F.sum(money("l_extendedprice")).alias("grand_total"))
    return plain(R.quality(rows, docs), "doc_id", "total_rows", "flagged_rows", "clean_rows", "total_amount", "coverage_pct", "qa_pass")


@query("nested_report", "S7 D3", f"""WITH {SALES} SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, count(DISTINCT code || place) AS n_stores, count(*) AS n_items FROM sales GROUP BY 1""")
def nested_report(spark, d):
    items = T.delimited_items(render.delimited_statement(spark, d), _formats(spark, d), party_as_store=True)
    nested = sinks.nest_report(items.withColumn("area", F.lit("UNKNOWN AREA")))
    stores = F.flatten(F.transform("Areas", lambda a: a["Stores"]))
    return plain(nested.select("doc_id", F.size(stores).alias("n_stores"),
                               F.aggregate(stores, F.lit(0), lambda n, s: n + F.size(s["Items"])).alias("n_items")))


@query("investigation_lines", "S11", f"""WITH {SHOPS} SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'fallback layout' AS reason, count(*) + 3 AS n_lines
FROM shops JOIN orders ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'no items', 3 FROM shops WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def investigation_lines(spark, d):
    lines = render.two_column_report(spark, d)
    o = render.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc_id")).agg(F.count("*").alias("n_items"))
    docs = render.shops(spark, d).select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit("LEGACY_UNIVERSAL_TWO_COLUMN").alias("detected_format"))
    dump = sinks.investigation_lines(lines, docs.join(o, "doc_id", "left"))
    return dump.groupBy("doc_id", "reason").agg(F.count("*").alias("n_lines"))


_RUNS: dict = {}


def _processed(spark, d):
    """One pipeline run per session and folder; its three result tables are queries of their own."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RUNS:
        _RUNS[key] = pipeline.process(render.summary_report(spark, d))
    return _RUNS[key]


@query("fact_table", "S8 D9 F16 E8 Q1 A10", f"""WITH {TOTALS} SELECT CAST(c_nationkey AS VARCHAR) AS "Source File", 'SHARMA TRADERS' AS "Agency Name", '01-01-1995' AS "From Date",
  '31-12-2001' AS "To Date", c_mktsegment || ' ZONE' AS "Area", code || ' MEDICAL STORE' AS "Store Name", replace(place, '_', ' ') AS "Store Location", 'CUMULATIVE SUMMARY' AS "Description",
  CAST(total AS DOUBLE) AS "Amount", 'STATEMENT' AS "Doc Type", 'FORMAT_12_OR_13' AS "Layout",
  CASE WHEN total > 500000 THEN 'UNUSUALLY_LARGE_AMOUNT|QTY_MISSING' ELSE 'QTY_MISSING' END AS "QA Flags" FROM totals""")
def fact_table(spark, d):
    """The whole pipeline over the summary reports: routed, read, cleaned, reconciled, as the 32-column table."""
    out = _processed(spark, d)
    return plain(out["fact"].select(*[F.col(f"`{c}`") for c in (
        "Source File", "Agency Name", "From Date", "To Date", "Area", "Store Name", "Store Location", "Description", "Amount", "Doc Type", "Layout", "QA Flags")]))


@query("qa_table", "S9 D10 Q6", f"""WITH {TOTALS} SELECT CAST(c_nationkey AS VARCHAR) AS "Source File", 'FORMAT_12_OR_13' AS "Layout", count(*) AS "Total Rows", count(*) AS "Flagged Rows",
  CAST(sum(total) AS DOUBLE) AS "Total Amount", 'NO' AS "QA Pass" FROM totals GROUP BY 1""")
def qa_table(spark, d):
    out = _processed(spark, d)
    return plain(out["qa"].select(*[F.col(f"`{c}`") for c in ("Source File", "Layout", "Total Rows", "Flagged Rows", "Total Amount", "QA Pass")]).where(
        F.col("Total Rows") > 0))


@query("run_summary", "S10 A11 D11", f"""WITH {TOTALS} SELECT CAST(c_nationkey AS VARCHAR) AS "File Name", 'Perfect Match' AS "Status", CAST(sum(total) AS DOUBLE) AS "Actual Amount", CAST(sum(total) AS DOUBLE) AS "CSV Amount"
FROM totals GROUP BY 1""")
def run_summary(spark, d):
    out = _processed(spark, d)
    return plain(out["summary"].where(F.col("Actual Amount") > 0).select(*[F.col(f"`{c}`") for c in ("File Name", "Status", "Actual Amount", "CSV Amount")]))
