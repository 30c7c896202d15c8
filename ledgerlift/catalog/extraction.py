"""Round trips: a corpus is printed from the order tables, read back, and must equal the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.registry import SALES, SHOPS, TOTALS, plain, query
from ledgerlift.operators import extract_rows as R
from ledgerlift.operators import extract_tables as T
from ledgerlift.operators.headers import read_lines
from ledgerlift.session import released, staged
from ledgerlift.sources import render

_STORE = "c.code || ' MEDICAL STORE' AS store_name".replace("c.", "")
_DOC = "CAST(c_nationkey AS VARCHAR) AS doc_id"
_AMOUNT = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount"
_QTY = "CAST(l_quantity AS BIGINT) AS qty"
_FREE = "CAST(free AS BIGINT) AS free"


def _rows(corpus, job, kind, *cols):
    def run(spark, d):
        printed = staged(corpus(spark, d), "lines")
        lines = read_lines(printed)  # read by several jobs, printed and cleaned once
        released(lines, printed)
        return released(plain(job(lines, R.doc_facts(lines), kind), *cols), lines)
    return run


# ------------------------------------------------------------------ summary layouts

query("right_peel_summary", "X1 X19 X26 X27 C5 C7 E1", f"WITH {TOTALS} SELECT {_DOC}, c_mktsegment || ' ZONE' AS area, {_STORE}, "
      "place AS store_location, 'CUMULATIVE SUMMARY' AS description, CAST(total AS DOUBLE) AS amount FROM totals")(
    _rows(render.summary_report, R.summary_items, "SUMMARY", "doc_id", "area", "store_name", "store_location", "description", "amount"))

query("flushed_summary", "C5 X19 E1", f"""WITH {TOTALS} SELECT {_DOC},
  code || ' GOODS OF THE FIRST CLASS AND SERVICES FOR EVERY HOUSE SINCE THE LAST FIVE AND TWENTY YEARS MEDICAL STORE' AS store_name,
  place || ' AND NEW' AS store_location, 0.0::DOUBLE AS amount FROM totals
UNION ALL SELECT {_DOC}, {_STORE}, place, CAST(total AS DOUBLE) FROM totals""")(
    _rows(render.wrapped_report, R.summary_items, "SUMMARY", "doc_id", "store_name", "store_location", "amount"))

_TOTAL = f"WITH {TOTALS} SELECT {_DOC}, {_STORE}, place AS store_location, CAST(total AS DOUBLE) AS amount FROM totals"
_SHOWN = ("doc_id", "store_name", "store_location", "amount")
query("quarterly_totals", "X20 X1", _TOTAL)(_rows(render.quarterly_report, R.summary_items, "QUARTERLY_SUMMARY", *_SHOWN))
query("maker_summary", "X18", _TOTAL)(_rows(render.maker_report, R.summary_items, "MFR_CUSTOMER_SUMMARY", *_SHOWN))
query("sales_analysis", "X15", _TOTAL)(_rows(render.analysis_report, R.sales_analysis_items, "SALES_ANALYSIS_SUMMARY", *_SHOWN))
query("party_sales_book", "X17", _TOTAL)(_rows(render.amount_first_book, R.sales_book_entries, "PARTY_SALES_BOOK", *_SHOWN))
query("two_column_items", "X21 X32", f"""WITH {SHOPS} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, {_STORE},
  'BILL ' || translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS description,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders JOIN shops ON o_custkey = c_custkey""")(
    _rows(render.two_column_report, R.two_column_items, "UNIVERSAL_TWO_COLUMN", "doc_id", "store_name", "description", "amount"))

# ------------------------------------------------------------------ registers and product layouts

_REG = ("doc_id", "store_name", "store_location", "description", "qty", "free", "rate", "amount")
_RATE = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS rate"
query("itemised_register", "X12 X2 X25 C7", f"WITH {SALES} SELECT {_DOC}, {_STORE}, place AS store_location, "
      f"date || ' B' || l_orderkey || ' ' || p_name AS description, {_QTY}, {_FREE}, {_RATE}, {_AMOUNT} FROM sales")(
    _rows(render.itemised_register, R.register_items, "SALE_REGISTER_ITEMIZED", *_REG))
query("partywise_register", "X13 X2 C7", f"WITH {SALES} SELECT {_DOC}, {_STORE}, place AS store_location, "
      f"p_name AS description, {_QTY}, {_FREE}, {_RATE}, {_AMOUNT} FROM sales")(
    _rows(render.partywise_register, R.register_items, "PARTYWISE_SALE_REGISTER", *_REG))
_PROD = ("doc_id", "store_name", "store_location", "description", "qty", "free", "amount")


def _product_sql(desc: str) -> str:
    return (f"WITH {SALES} SELECT {_DOC}, {_STORE}, place AS store_location, {desc} AS description, {_QTY}, {_FREE}, {_AMOUNT} "
            "FROM sales")


query("customer_products", "X16", _product_sql("p_name"))(
    _rows(render.customer_products, R.customer_product_items, "CUSTOMER_PRODUCT_SALES", *_PROD))
query("customer_products_netted", "X16", _product_sql("p_name"))(
    _rows(lambda s, d: render.customer_products(s, d, netted=True), R.customer_product_items, "CUSTOMER_WISE_PRODUCT_WISE", *_PROD))
query("party_products", "X22", _product_sql("p_name || ' 10ML'"))(
    _rows(render.party_products, R.party_product_items, "PARTY_PRODUCT_WISE", *_PROD))
query("party_wise_items", "X23 X2", _product_sql("p_name"))(_rows(render.party_items, R.wise_items, "PARTY_WISE", *_PROD))
query("item_wise_stores", "X23", f"WITH {SALES} SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, code || ' PHARMACY' AS store_name, "
      f"p_name || ' KIT' AS description, {_QTY}, {_AMOUNT} FROM sales")(
    _rows(render.item_stores, R.wise_items, "ITEM_WISE", "doc_id", "store_name", "description", "qty", "amount"))
query("single_party_invoices", "X14 X24 X32 C6", f"""WITH {SALES} SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, {_STORE},
  l_linenumber || '. ' || p_name AS description, {_QTY}, {_AMOUNT} FROM sales
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'C' || o_custkey || ' MEDICAL STORE', 'CASH DISCOUNT', 0,
  -CAST(((o_orderkey * 7) % 1000 + 1) / 100.0 AS DOUBLE) FROM orders""")(
    _rows(render.single_invoices, R.single_party_items, "INVOICE_SINGLE_PARTY", "doc_id", "store_name", "description", "qty", "amount"))


# ------------------------------------------------------------------ tables

@query("statement_items", "X3 D12", f"""WITH {SALES} SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, p_name AS description,
  code || ' MEDICAL STORE, ' || place AS store_name, '1*' || (p_size + 1) AS packing, {_QTY}, {_FREE}, {_RATE}, {_AMOUNT} FROM sales""")
def statement_items(spark, d):
    lines = render.delimited_statement(spark, d)
    formats = render.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"),
                                                        F.lit("BUSY_PARTY_PRODUCT_WISE").alias("format_id"))
    return plain(T.delimited_items(lines, formats, party_as_store=True), "doc_id", "description", "store_name", "packing", "qty", "free",
                 "rate", "amount")


_FLAT_NAMES = ", ".join(f"'{p}'" for p in render.FLAT_PRODUCTS)
_FLAT = f"""WITH {SALES}, carried AS (
  SELECT *, last_value(CASE WHEN l_linenumber % 2 = 1 THEN code END IGNORE NULLS) OVER w AS named,
    last_value(CASE WHEN l_linenumber % 2 = 1 THEN place END IGNORE NULLS) OVER w AS town,
    list_element([{_FLAT_NAMES}], CAST(l_partkey % 6 + 1 AS BIGINT)) AS product
  FROM sales WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
flat AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, CASE WHEN named IS NULL THEN 'UNKNOWN STORE' ELSE named || ' MEDICALS' END
  AS store_name, coalesce(town, '') AS store_location, product AS description, '10*10' AS packing, {_QTY}, {_FREE}, {_RATE},
  {_AMOUNT}, l_extendedprice FROM carried)"""


@query("flat_items", "X28 T10 C7", _FLAT + " SELECT doc_id, store_name, store_location, description, packing, qty, free, rate, amount FROM flat")
def flat_items(spark, d):
    return plain(T.flat_items(render.flat_statement(spark, d)), "doc_id", "store_name", "store_location", "description", "packing",
                 "qty", "free", "rate", "amount")


@query("flat_store_totals", "X28", _FLAT + """ SELECT doc_id, store_name, count(*) AS n_items, CAST(sum(qty) AS BIGINT) AS qty,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM flat GROUP BY 1, 2""")
def flat_store_totals(spark, d):
    return plain(T.merge_flat_stores(T.flat_items(render.flat_statement(spark, d))), "doc_id", "store_name", "n_items", "qty", "amount")


_READER = f"""WITH {SALES}, named AS (SELECT *, 'Shop ' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || ' Medical'
  AS store FROM sales)"""


@query("flat_table_rows", "X29", _READER + f""" SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, store AS store_name, 'N' AS store_location,
  substr(replace(place, '_', ' '), 2) || ' Road' AS area, p_name AS product, CAST({_QTY.split(' AS qty')[0]} AS VARCHAR) AS qty, {_AMOUNT} FROM named""")
def flat_table_rows(spark, d):
    rows = T.flat_table_rows(render.flat_reader_statement(spark, d)).where(F.col("product") != "")
    return rows.select("doc_id", "store_name", "store_location", "area", "product", "qty", F.col("amount").cast("double").alias("amount"))


@query("flat_table_summary", "X30", f"""WITH {SALES}, s AS (SELECT c_nationkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q,
  sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS a FROM sales GROUP BY 1),
k AS (SELECT c_nationkey, count(*) AS shops FROM shops GROUP BY 1)
SELECT CAST(k.c_nationkey AS VARCHAR) AS doc_id, shops + coalesce(n, 0) AS total_rows, shops AS unique_stores,
  CAST(coalesce(a, 0) AS DOUBLE) AS total_amount, coalesce(q, 0) AS total_qty, CAST(1 AS BIGINT) AS n_areas
FROM k LEFT JOIN s ON k.c_nationkey = s.c_nationkey""")
def flat_table_summary(spark, d):
    return plain(T.flat_table_summary(T.flat_table_rows(render.flat_reader_statement(spark, d))))


_CENT = "CAST(((o_orderkey * {k}) % 1000) / 100.0 AS DOUBLE) AS {n}"
_BOOK = ", ".join(_CENT.format(k=k, n=n) for k, n in zip((3, 7, 11, 13, 17, 19), T.BOOK_FIELDS[1:]))


@query("sales_book_items", "X11", f"""SELECT strftime(o_orderdate, '%Y-%m') AS doc_id, 'C' || o_custkey || ' MEDICAL STORE' AS store_name,
  strftime(o_orderdate, '%d-%m-%Y') AS bill_date, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'AB' END
  || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS bill_no, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, {_BOOK} FROM orders""")
def sales_book_items(spark, d):
    return plain(T.sales_book_items(render.sales_book(spark, d)), "doc_id", "store_name", "bill_date", "bill_no", *T.BOOK_FIELDS)


@query("sales_book_period", "T16 X11", """SELECT strftime(o_orderdate, '%Y-%m') AS doc_id, strftime(min(o_orderdate), '%d-%m-%Y') AS from_date,
  strftime(max(o_orderdate), '%d-%m-%Y') AS to_date FROM orders GROUP BY 1""")
def sales_book_period(spark, d):
    return T.period_of(T.sales_book_items(render.sales_book(spark, d)))


_SOLD = "(SELECT DISTINCT l_orderkey FROM lineitem)"


@query("paged_invoice_items", "X10 T13", f"""WITH {SALES} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, {_STORE},
  replace(place, '_', ' ') AS store_location, p_name || ' 10X10' AS description, {_QTY}, {_AMOUNT}, 'B' || l_partkey AS batch,
  'JAN25' AS expiry, '30049099' AS hsn FROM sales
UNION ALL SELECT CAST(o_custkey AS VARCHAR), code || ' MEDICAL STORE', replace(place, '_', ' '), v.x, 0,
  CASE WHEN v.x = 'Round off' THEN 0.4 ELSE CAST(((o_orderkey * 7) % 1000 + 1) / 100.0 AS DOUBLE) END, NULL, NULL, NULL
FROM orders JOIN {_SOLD} s ON o_orderkey = l_orderkey JOIN shops ON o_custkey = c_custkey,
  (VALUES ('Round off'), ('SGST CGST ADD GST')) v(x)""")
def paged_invoice_items(spark, d):
    return plain(T.paged_invoice_items(render.paged_invoices(spark, d)), "doc_id", "store_name", "store_location", "description", "qty",
                 "amount", "batch", "expiry", "hsn")


@query("paged_invoice_totals", "X10 A2 T16", """SELECT CAST(o_custkey AS VARCHAR) AS doc_id,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS grand_total, strftime(min(o_orderdate), '%d/%m/%Y') AS from_date,
  strftime(max(o_orderdate), '%d/%m/%Y') AS to_date, count(DISTINCT o_orderkey) AS n_invoices
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def paged_invoice_totals(spark, d):
    return plain(T.paged_invoice_totals(render.paged_invoices(spark, d)))


@query("tax_invoice_items", "X31 C6", f"""WITH {SALES} SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, {_STORE}, p_name AS brand, 'CAP' AS dosage,
  '10TAB' AS packing, 'K' || l_partkey AS batch, '12/26' AS expiry, '30049099' AS hsn, {_QTY}, {_RATE}, {_AMOUNT},
  CAST(2 * CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE) AS tax_amount FROM sales""")
def tax_invoice_items(spark, d):
    lines = staged(render.tax_invoices(spark, d), "lines")
    return plain(T.tax_invoice_items(lines, R.doc_facts(lines)), "doc_id", "store_name", "brand", "dosage", "packing", "batch", "expiry",
                 "hsn", "qty", "rate", "amount", "tax_amount")


@query("tax_rows_across_pages", "X31 C6", f"""WITH {SALES} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, p_name AS brand, 'CAP' AS dosage,
  '10TAB' AS packing, 'K' || l_partkey AS batch, '12/26' AS expiry, '30049099' AS hsn, {_QTY}, {_RATE}, {_AMOUNT},
  CAST(2 * CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE) AS tax_amount FROM sales""")
def tax_rows_across_pages(spark, d):
    return plain(T.tax_invoice_items(render.broken_tax_invoices(spark, d)), "doc_id", "brand", "dosage", "packing", "batch", "expiry", "hsn",
                 "qty", "rate", "amount", "tax_amount")


@query("tax_invoice_rows_early", "X31", f"""WITH {SALES} SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, '30049099' AS hsn, {_AMOUNT} FROM sales""")
def tax_invoice_rows_early(spark, d):
    return plain(T.tax_invoice_rows_early(render.tax_invoices(spark, d)), "doc_id", "hsn", "amount")


# ------------------------------------------------------------------ inferred columns

@query("inferred_schema_items", "X4 X5 X6 X8 X9", """SELECT strftime(o_orderdate, '%Y-%m') AS doc_id, 'C' || o_custkey || ' MEDICAL STORE'
  AS store_name, 'BILL AMOUNT' AS description, strftime(o_orderdate, '%d-%m-%Y') AS bill_date,
  'AB' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS bill_no, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
  CAST(((o_orderkey * 3) % 1000) / 100.0 AS DOUBLE) AS taxable, CAST(((o_orderkey * 7) % 1000) / 100.0 AS DOUBLE) AS tax FROM orders""")
def inferred_schema_items(spark, d):
    return plain(T.inferred_items(render.wide_register(spark, d)), "doc_id", "store_name", "description", "bill_date", "bill_no",
                 "amount", "taxable", "tax")


@query("column_position_items", "X7 X9 C7", f"""WITH {SALES} SELECT {_DOC}, {_STORE}, p_name AS description, date AS bill_date,
  'B' || l_orderkey AS bill_no, {_QTY}, {_RATE}, {_AMOUNT} FROM sales""")
def column_position_items(spark, d):
    return plain(T.inferred_items(render.column_register(spark, d)), "doc_id", "store_name", "description", "bill_date", "bill_no", "qty",
                 "rate", "amount")


@query("header_columns", "X4 X5 D18", """SELECT strftime(o_orderdate, '%Y-%m') AS doc_id, v.* FROM (SELECT DISTINCT date_trunc('month', o_orderdate)
  AS o_orderdate FROM orders), (VALUES ('DATE', 'date', 0, 12), ('BILL NO', 'bill_no', 12, 22), ('PARTY NAME', 'store', 22, 44),
  ('BILL AMT', 'amount', 44, 57), ('TAXABLE', 'taxable', 57, 67), ('TAX', 'tax', 67, 9999)) v(col_name, role, x_start, x_end)""".replace(
    "v.*", "v.col_name, v.role, CAST(v.x_start AS BIGINT) AS x_start, CAST(v.x_end AS BIGINT) AS x_end"))
def header_columns(spark, d):
    cols = T.doc_columns(render.wide_register(spark, d))
    return plain(cols.select("doc_id", F.explode("cols").alias("c")).select("doc_id", "c.*"))
