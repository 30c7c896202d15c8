"""Layout detection over printed corpora."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ledgerlift.catalog.registry import SALES, plain, query
from ledgerlift.operators import detect as D
from ledgerlift.operators import extract_tables as T
from ledgerlift.operators.headers import header_view
from ledgerlift.sources import render

_CORPORA = {
    # corpus: (printer, document keys as SQL, layout id, report type)
    "summary": (render.summary_report, "SELECT n_nationkey FROM nation", "'FORMAT_12_OR_13'", "SUMMARY"),
    "quarter": (render.quarterly_report, "SELECT n_nationkey FROM nation",
                "CASE WHEN k % 2 = 1 THEN 'FORMAT_21' ELSE 'FORMAT_07' END", "QUARTERLY_SUMMARY"),
    "maker": (render.maker_report, "SELECT n_nationkey FROM nation", "'FORMAT_15_OR_16'", "MFR_CUSTOMER_SUMMARY"),
    "book": (render.amount_first_book, "SELECT n_nationkey FROM nation", "'FORMAT_06'", "PARTY_SALES_BOOK"),
    "columns": (render.two_column_report, "SELECT c_custkey FROM customer", "'FORMAT_08'", "UNIVERSAL_TWO_COLUMN"),
    "register": (render.itemised_register, "SELECT n_nationkey FROM nation", "'FORMAT_14'", "SALE_REGISTER_ITEMIZED"),
    "partywise": (render.partywise_register, "SELECT n_nationkey FROM nation", "'FORMAT_28_PARTYWISE'", "PARTYWISE_SALE_REGISTER"),
    "party": (render.party_products, "SELECT n_nationkey FROM nation", "'FORMAT_03'", "PARTY_PRODUCT_WISE"),
    "item": (render.item_stores, "SELECT s_suppkey FROM supplier", "'FORMAT_23_OR_24'", "ITEM_WISE"),
}


_SOLD = (render.itemised_register, render.partywise_register, render.customer_products, render.party_products, render.party_items, render.item_stores,
         render.delimited_statement, render.flat_statement, render.tax_invoices, render.single_invoices)


def _corpus(spark, d, named=None, sold=None):
    """Reports of several printers in one frame, named by their kind. Printers of order lines share one join of them."""
    named = named or {name: c[0] for name, c in _CORPORA.items()}
    sold = sold or render.written_sales(spark, d)
    lines = {n: fn(spark, d, sold=sold) if getattr(fn, "func", fn) in _SOLD else fn(spark, d) for n, fn in named.items()}
    return render.union(*[x.withColumn("doc_id", F.concat(F.lit(n + "_"), "doc_id")) for n, x in lines.items()])


_EXPECTED = " UNION ALL ".join(
    f"SELECT '{n}_' || k AS doc_id, {fmt} AS format_id, '{kind}' AS report_type FROM ({keys}) t(k)"
    for n, (_, keys, fmt, kind) in _CORPORA.items())


@query("fingerprint_route", "F2 F3 F4 T3 T4 D15", _EXPECTED)
def fingerprint_route(spark, d):
    heads = header_view(_corpus(spark, d))
    return heads.withColumn("f", D.fingerprint()).select("doc_id", "f.format_id", "f.report_type")


@query("legacy_route", "F6", """SELECT 'a_' || n_nationkey AS doc_id, 'SALES_ANALYSIS_SUMMARY' AS report_type FROM nation UNION ALL
SELECT 'c_' || n_nationkey, 'CUSTOMER_PRODUCT_SALES' FROM nation UNION ALL SELECT 'w_' || n_nationkey, 'CUSTOMER_WISE_PRODUCT_WISE' FROM nation
UNION ALL SELECT 'p_' || n_nationkey, 'PARTY_WISE' FROM nation UNION ALL SELECT 'i_' || o_orderkey, 'INVOICE_SINGLE_PARTY' FROM orders""")
def legacy_route(spark, d):
    named = {"a": render.analysis_report, "c": render.customer_products, "w": partial(render.customer_products, netted=True),
             "p": render.party_items, "i": render.single_invoices}
    return header_view(_corpus(spark, d, named)).select("doc_id", D.legacy_report_type().alias("report_type"))


@query("keyword_route", "F1 D16", """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'STANDARD_GST_INVOICE' AS format_id, CAST(7 AS BIGINT) AS score FROM orders""")
def keyword_route(spark, d):
    k = D.keyword_scores(render.tax_invoices(spark, d))
    return plain(k.select("doc_id", "keyword.format_id", "keyword.score"))


@query("delimited_route", "F7 D13", """SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'BUSY_PARTY_PRODUCT_WISE' AS format_id FROM supplier""")
def delimited_route(spark, d):
    return header_view(render.delimited_statement(spark, d)).select("doc_id", D.delimited_schema().alias("format_id"))


@query("flat_route", "F5", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS doc_id, true AS is_flat FROM lineitem")
def flat_route(spark, d):
    return header_view(render.flat_statement(spark, d)).select("doc_id", D.flat_rows_hit().alias("is_flat"))


# the first 40 lines of the flat statements; every supplier here has more than 40 order lines
_STEMS = "HEPP|LUPI|ONECLAV|DEFENAC|BILALUP|REVEAL|CEFP|MEGARICH|PANTOLUP|AZILUP|CIPROVA|LUPICEF|XIMECEF|FLUCALUP"
_NAMES = ", ".join(f"'{p}'" for p in render.FLAT_PRODUCTS)
_FLAT_LINES = f"""WITH {SALES}, n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM sales),
body AS (SELECT l_suppkey, l_orderkey * 1024 + seq AS pos, c_nationkey || ' ' || place || chr(9) || CASE WHEN l_linenumber % 2 = 1 THEN code ELSE '' END || chr(9)
  || CASE WHEN l_linenumber % 2 = 1 THEN 'MEDICALS' ELSE '' END || chr(9) || list_element([{_NAMES}], CAST(l_partkey % 6 + 1 AS BIGINT)) || chr(9) || '10*10' || chr(9)
  || CAST(l_quantity AS BIGINT) || chr(9) || free || chr(9) || CAST(p_retailprice AS DECIMAL(18,2)) || chr(9) || CAST(l_extendedprice AS DECIMAL(18,2)) || chr(9) || 'LUPIN' AS text FROM n),
foot AS (SELECT l_suppkey, 9000000000000000000 AS pos, 'GRAND TOTAL' || chr(9) || sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS text FROM lineitem GROUP BY 1),
lines AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, pos, text, string_split(text, chr(9)) AS c FROM (SELECT * FROM body UNION ALL SELECT * FROM foot)
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY pos) <= 40)"""


def _share(cond: str) -> str:
    return f"round(avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)::DOUBLE, 6)"


_FEATURES = ["n_lines", "mean_cols", "modal_cols", "max_cols", "digit_ratio", "alpha_ratio", "amt_line_frac", "gstin_frac", "date_frac",
             "bill_frac", "hsn_frac", "batch_frac", "expiry_frac", "subtotal_frac", "party_header_frac", "drug_line_frac", "leading_int_frac", "tab_std"]


@query("layout_features", "F8 F9", _FLAT_LINES + rf""" SELECT doc_id, count(*) AS n_lines, round(avg(len(c))::DOUBLE, 6) AS mean_cols, CAST(mode(len(c)) AS BIGINT) AS modal_cols,
  CAST(max(len(c)) AS BIGINT) AS max_cols, round((sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) / sum(length(text)))::DOUBLE, 6) AS digit_ratio,
  round((sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) / sum(length(text)))::DOUBLE, 6) AS alpha_ratio,
  {_share(r"regexp_matches(text, '\b\d{2,7}\.\d{2}\b')")} AS amt_line_frac, 0.0::DOUBLE AS gstin_frac,
  {_share(r"regexp_matches(text, '\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b')")} AS date_frac,
  {_share(r"regexp_matches(text, '(?i)\b(bill|invoice|vch|voucher)\s*(no|#|num)')")} AS bill_frac, {_share(r"regexp_matches(text, '(?i)\bhsn\b')")} AS hsn_frac,
  {_share(r"regexp_matches(text, '(?i)\b(batch|b\.no|exp\.?|expiry)\b')")} AS batch_frac, {_share(r"regexp_matches(text, '\b\d{1,2}[-/]\d{4}\b')")} AS expiry_frac,
  {_share(r"regexp_matches(text, '(?i)\bsub\s*total\b')")} AS subtotal_frac,
  {_share(r"regexp_matches(text, '(?i)\b(party\s*(name|wise)|customer|store\s*name)\b')")} AS party_header_frac,
  {_share(rf"regexp_matches(text, '(?i)\b(?:{_STEMS})\w*')")} AS drug_line_frac, {_share(r"regexp_matches(c[1], '^\d{3,8}$')")} AS leading_int_frac,
  round(coalesce(stddev_pop(len(c)), 0)::DOUBLE, 6) AS tab_std, 'FLAT_PARTY_PRODUCT' AS format_id, 0.82::DOUBLE AS confidence FROM lines GROUP BY 1""")
def layout_features(spark, d):
    f = D.layout_features(render.flat_statement(spark, d)).withColumn("s", D.structural_class())
    shown = [F.round(c, 6).alias(c) if c not in ("n_lines", "modal_cols", "max_cols") else F.col(c) for c in _FEATURES]
    return f.select("doc_id", *shown, "s.format_id", "s.confidence")


_PROBE = _FLAT_LINES + """, good AS (SELECT doc_id, pos, c FROM lines WHERE text NOT LIKE 'GRAND TOTAL%' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 30),
cells AS (SELECT doc_id, i AS col, trim(c[i + 1]) AS v FROM good, unnest(range(10)) u(i)),
kinds AS (SELECT doc_id, col, CASE WHEN v = '' THEN 'empty' WHEN regexp_matches(v, '^-?\\d{1,7}\\.\\d{2}$') THEN 'amount' WHEN v = 'LUPIN' THEN 'company_tag'
  WHEN regexp_matches(v, '(?i)^(HEPP|ONECLAV|DEFENAC|REVEAL|MEGARICH|CIPROVA)') THEN 'drug' WHEN v = '10*10' THEN 'packing'
  WHEN regexp_matches(v, '^\\d{4,8}$') THEN 'hsn' WHEN regexp_matches(v, '^\\d{1,6}$') THEN 'integer' WHEN regexp_matches(v, '[A-Za-z]{3,}') THEN 'text' ELSE 'other' END AS kind FROM cells),
prof AS (SELECT doc_id, col, """ + ", ".join(
    f"avg(CASE WHEN kind = '{k}' THEN 1.0 ELSE 0.0 END)::DOUBLE AS {k}" for k in ("amount", "company_tag", "drug", "packing", "integer", "text", "empty")) + " FROM kinds GROUP BY 1, 2)"


@query("column_probe", "F10 F11", _PROBE + """ SELECT doc_id, CAST(10 AS BIGINT) AS modal, CAST(col AS BIGINT) AS col, round(amount, 6) AS amount, round(company_tag, 6) AS company_tag,
  round(drug, 6) AS drug, round(packing, 6) AS packing, round("integer", 6) AS "integer", round("text", 6) AS "text", round(empty, 6) AS empty FROM prof""")
def column_probe(spark, d):
    p = D.column_probe(D.conforming_rows(render.flat_statement(spark, d)))
    return plain(p.select("doc_id", "modal", "col", *[F.round(c, 6).alias(c) for c in
                                                      ("amount", "company_tag", "drug", "packing", "integer", "text", "empty")]))


@query("template_score", "F12", _PROBE + """ SELECT doc_id, 'FLAT_PARTY_PRODUCT' AS format_id, round(least(sum(CASE col WHEN 0 THEN 1.0 * "text" WHEN 1 THEN 0.8 * "text" WHEN 2 THEN 0.5 * "text"
  WHEN 3 THEN 1.5 * drug WHEN 4 THEN packing WHEN 5 THEN 0.8 * "integer" WHEN 6 THEN 0.6 * "integer" WHEN 7 THEN amount WHEN 8 THEN 1.5 * amount ELSE 1.2 * company_tag END) / 9.9, 0.95)::DOUBLE, 6)
  AS confidence FROM prof GROUP BY 1""")
def template_score(spark, d):
    best = D.best_template(D.template_scores(D.column_probe(D.conforming_rows(render.flat_statement(spark, d)))))
    return best.select("doc_id", "format_id", F.round("confidence", 6).alias("confidence"))


@query("discover_columns", "F13", """SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS doc_id, CAST(3 AS BIGINT) AS product_name, CAST(4 AS BIGINT) AS packing, CAST(9 AS BIGINT) AS company,
  CAST(0 AS BIGINT) AS store_name, 0.8::DOUBLE AS confidence FROM lineitem""")
def discover_columns(spark, d):
    c = D.discover_columns(D.column_probe(D.conforming_rows(render.flat_statement(spark, d))))
    pick = lambda k: F.try_element_at("column_map", F.lit(k)).alias(k)
    return plain(c.select("doc_id", pick("product_name"), pick("packing"), pick("company"), pick("store_name"), F.round("confidence", 6).alias("confidence")))


@query("inferred_layout", "F14 F15 D14 D20", """SELECT DISTINCT 'flat_' || l_suppkey AS doc_id, 'FLAT_PARTY_PRODUCT' AS format_id, CAST(1 AS BIGINT) AS tier, 'structure' AS source FROM lineitem
UNION ALL SELECT 'summary_' || n_nationkey, 'LEARNED_SUMMARY', 3, 'learned' FROM nation""")
def inferred_layout(spark, d):
    flat = render.flat_statement(spark, d).withColumn("doc_id", F.concat(F.lit("flat_"), "doc_id"))
    summ = render.summary_report(spark, d).withColumn("doc_id", F.concat(F.lit("summary_"), "doc_id"))
    # layouts learned earlier, one per key: narrow reports with and without dense amounts
    learned = spark.createDataFrame([("cols1_drugN_amtY", "LEARNED_SUMMARY", 0.6), ("cols1_drugN_amtN", "LEARNED_SUMMARY", 0.6)],
                                    "key string, format_id string, confidence double")
    found = D.infer_layout(render.union(flat, summ), learned)
    return plain(found.select("doc_id", "inferred.format_id", "inferred.tier", "inferred.source"))


@query("full_route", "F16 F1 F2 F5 F7 D4", _EXPECTED.replace("'FORMAT_08'", "'SCHEMA_INFERRED'").replace("'UNIVERSAL_TWO_COLUMN'", "'SCHEMA_INFERRED'")
       + """ UNION ALL SELECT 'busy_' || s_suppkey, 'BUSY_PARTY_PRODUCT_WISE', 'DELIMITED' FROM supplier
UNION ALL SELECT DISTINCT 'flat_' || l_suppkey, 'FLAT_PARTY_PRODUCT', 'FLAT_PARTY_PRODUCT' FROM lineitem
UNION ALL SELECT 'tax_' || o_orderkey, 'STANDARD_GST_INVOICE', 'INVOICE' FROM orders""")
def full_route(spark, d):
    from ledgerlift.plans.pipeline import route_with_roles
    more = {"busy": render.delimited_statement, "flat": render.flat_statement, "tax": render.tax_invoices}
    sold = render.written_sales(spark, d)
    return route_with_roles(render.union(_corpus(spark, d, sold=sold), _corpus(spark, d, more, sold))).select("doc_id", "format_id", "report_type")


@query("role_headers", "X5 X6 D17", """SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS doc_id, CAST(2 AS BIGINT) AS header_line FROM orders""")
def role_headers(spark, d):
    return T.doc_columns(render.wide_register(spark, d)).select("doc_id", "header_line")
