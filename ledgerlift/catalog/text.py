"""Text and number normalisation, lines, pages, entities and item descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.registry import SALES, SHOPS, plain, query
from ledgerlift.functions import entities as E
from ledgerlift.functions import numbers as N
from ledgerlift.functions import text as T
from ledgerlift.functions.common import words_of
from ledgerlift.operators import continuity as C
from ledgerlift.operators import headers as H
from ledgerlift.operators import postprocess as P
from ledgerlift.operators import tokens as K
from ledgerlift.operators.extract_rows import as_items
from ledgerlift.sources import lines as S
from ledgerlift.sources import render


def _docs(spark, d):
    return render.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")


# ------------------------------------------------------------------ lines and pages

@query("line_explode", "S5 D1 D2", """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(i AS BIGINT) AS line_no, CAST(length(a[i + 1]) AS BIGINT) AS n_chars
FROM p, unnest(range(len(a))) t(i)""")
def line_explode(spark, d):
    return plain(S.document_lines(_docs(spark, d)).select("doc_id", "line_no", F.length("text").alias("n_chars")))


@query("page_quality", "Q5", r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(length(text) AS BIGINT) AS char_count,
  length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) / length(text)::DOUBLE AS num_density,
  CAST(len(regexp_extract_all(text, '\b\d+[\.,]\d{2}\b')) AS BIGINT) AS financial_rows,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\b\d+(?:\.\d+)?\b')) >= 3)) AS BIGINT) AS table_rows,
  length(text) < 150 OR length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) / length(text)::DOUBLE < 0.03 AS weak
FROM documents WHERE regexp_matches(text, '\S')""")
def page_quality(spark, d):
    docs = _docs(spark, d).where(F.col("text").rlike(r"\S"))
    return docs.withColumn("q", T.page_quality("text")).select("doc_id", "q.*")


@query("text_confidence", "Q3", r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, string_split(text, chr(10)) AS a,
  length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) AS dig, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS alp,
  length(text)::DOUBLE AS n FROM documents),
e AS (SELECT *, len(a)::DOUBLE AS n_all, len(list_filter(a, lambda x: regexp_matches(x, '\S')))::DOUBLE AS filled,
  len(list_filter(a, lambda x: regexp_matches(x, '\S') AND contains(x, chr(9))))::DOUBLE AS tabbed FROM d)
SELECT doc_id, round(CASE WHEN NOT regexp_matches(text, '\S') THEN 0.0 WHEN dig / n > 0.85 THEN 0.25 WHEN alp < 5 THEN 0.10
  ELSE least(0.4 * dig / n + 0.3 * tabbed / filled + 0.3 * filled / n_all
    + CASE WHEN regexp_matches(text, '\d{2,}[\.,]\d{2}') THEN 0.05 ELSE 0.0 END
    + CASE WHEN alp / n > 0.15 THEN 0.05 ELSE 0.0 END, 1.0) END::DOUBLE, 9) AS score FROM e""")
def text_confidence(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.text_confidence("text"), 9).alias("score"))


@query("html_to_lines", "S3", r"""WITH t AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '</tr>', chr(10), 'gi'),
  '</td>', chr(9), 'gi'), '<[^>]+>', '', 'g'), chr(10)) AS a FROM pages),
r AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(x, chr(9)), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')),
  lambda c: c <> ''), chr(9)) AS line FROM t, unnest(a) u(x))
SELECT CAST(page_id AS VARCHAR) AS doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM r WHERE line <> '' GROUP BY 1""")
def html_to_lines(spark, d):
    lines = S.html_lines(render.table(spark, d, "pages"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query("delimited_lines", "S2 S4", """SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(v.i AS BIGINT) AS line_no,
  CASE v.i WHEN 0 THEN p_name || chr(9) || p_brand || chr(9) || p_size ELSE p_type END AS text FROM part, (VALUES (0), (2)) v(i)""")
def delimited_lines(spark, d):
    p = render.table(spark, d, "part")
    sep = F.when(F.col("p_partkey") % 2 == 0, ",").otherwise("\t")
    text = F.concat(F.col("p_name"), F.lit("  "), sep, F.col("p_brand"), sep, sep, F.lit(" "), F.col("p_size").cast("string"),
                    F.lit("\n "), sep, F.lit("\n"), F.col("p_type"), sep)
    return S.delimited_lines(p.select(F.col("p_partkey").cast("string").alias("doc_id"), text.alias("text"))).select("doc_id", "line_no", "text")


@query("billable_units", "S6", r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, ['pdf','csv','png','xlsx','txt','jpeg'][doc_id % 6 + 1] AS ext,
  length(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[^\n]', '', 'g')) + 1 AS n FROM documents)
SELECT doc_id, CAST(CASE WHEN ext = 'pdf' THEN 1 WHEN ext IN ('png', 'jpeg') THEN 3 WHEN ext = 'txt' THEN 0
  ELSE greatest(1, ceil(n / 50.0)) END AS BIGINT) AS pages_billed FROM d""")
def billable_units(spark, d):
    docs = _docs(spark, d)
    ext = F.element_at(F.array(*[F.lit(e) for e in ("pdf", "csv", "png", "xlsx", "txt", "jpeg")]), (F.col("doc_id").cast("bigint") % 6 + 1).cast("int"))
    return S.billed_documents(docs.withColumn("extension", ext)).select("doc_id", "pages_billed")


@query("supported_files", "S1", """SELECT 'in/' || event_id || ['.PDF','.csv','.doc','.jpeg'][event_id % 4 + 1] AS path,
  ['pdf','csv','doc','jpeg'][event_id % 4 + 1] AS extension FROM events WHERE event_id % 4 <> 2""")
def supported_files(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".PDF", ".csv", ".doc", ".jpeg")]), (F.col("event_id") % 4 + 1).cast("int"))
    paths = render.table(spark, d, "events").select(F.concat(F.lit("in/"), F.col("event_id").cast("string"), ext).alias("path"))
    return S.with_extension(paths).where(F.col("extension").isin(*S.EXTENSIONS)).select("path", "extension")


_PAGES = r"""WITH p AS (SELECT conv_id, turn, string_split((turn + 1) || chr(10) || CASE WHEN turn % 2 = 1 THEN 'joined-' || chr(10) ELSE '' END || text,
  chr(10)) AS a FROM conversations), n AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1),
l AS (SELECT p.conv_id, turn, last, i, a[i + 1] AS t FROM p JOIN n ON p.conv_id = n.conv_id, unnest(range(len(a))) u(i)),
k AS (SELECT *, max(i) OVER (PARTITION BY conv_id, turn) AS tail FROM l
  WHERE last = 0 OR (regexp_matches(t, '\S') AND NOT regexp_matches(trim(t), '^(?i:-?\d+\s*-?\s*$|page\s+\d+|continued\.\.\.?|contd\.?)') AND t <> 'joined-'))"""


@query("continuous_lines", "C1 C2", _PAGES + """ SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS BIGINT) AS page_no,
  t || CASE WHEN last > 0 AND i = tail AND turn % 2 = 0 AND turn < last THEN 'joined' ELSE '' END AS text FROM k""")
def continuous_lines(spark, d):
    c = render.table(spark, d, "conversations")
    page = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), F.when(F.col("turn") % 2 == 1, "joined-\n").otherwise(""), F.col("text"))
    lines = c.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_no"),
                     F.posexplode(F.split(page, "\n")).alias("i", "text"))
    lines = lines.select("doc_id", "page_no", (F.col("page_no") * 1_000_000 + F.col("i")).cast("bigint").alias("line_no"), "text")
    return plain(C.continuous_lines(lines), "doc_id", "page_no", "text")


@query("split_rows", "C3", r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, i, regexp_replace(a[i + 1], '^\s+|\s+$', '', 'g') AS t, regexp_replace(a[i + 2], '^\s+|\s+$', '', 'g') AS nx
  FROM p, unnest(range(len(a) - 1)) u(i)),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS tw, list_filter(regexp_split_to_array(nx, '\s+'), lambda x: x <> '') AS nw FROM l WHERE t <> '' AND nx <> '')
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(i AS BIGINT) AS line_no, 'dangling' AS reason FROM w WHERE regexp_matches(t, '[-,]$')
UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 'numeric' FROM w WHERE len(tw) >= 3 AND len(nw) >= 2
  AND regexp_matches(replace(tw[-1], '.', ''), '^\d+$') AND regexp_matches(replace(nw[1], '.', ''), '^\d+$')""")
def split_rows(spark, d):
    return C.split_rows(S.document_lines(_docs(spark, d))).select("doc_id", "line_no", "reason")


@query("rebuild_rows", "C4")
def rebuild_rows(spark, d):
    return C.rebuild_rows(S.document_lines(_docs(spark, d)))


# ------------------------------------------------------------------ numbers

_DIGITS = r"regexp_replace(translate(regexp_replace(t, '^(.*)[-−]$', '-\1'), '(', '-'), '[^0-9.\-]', '', 'g')"
_DATED = r"regexp_matches(t, '\b\d{1,2}[-/]\d{1,2}(?:[-/]\d{2,4})?\b')"


@query("document_numbers", "T5 T6", rf"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS t FROM documents),
g AS (SELECT doc_id, t, {_DIGITS} AS g, {_DATED} AS dated FROM w WHERE regexp_matches(t, '[0-9]')),
v AS (SELECT doc_id, CASE WHEN NOT dated AND regexp_matches(g, '^-?(\d{{1,9}}(\.\d*)?|\.\d+)$') THEN round(TRY_CAST(g AS DECIMAL(38,9)), 2) ELSE 0 END AS v,
  NOT dated AND NOT regexp_matches(regexp_replace(upper(t), 'CR|DR', '', 'g'), '[A-Z*]') AND regexp_matches(g, '^-?(\d{{1,12}}(\.\d*)?|\.\d+)$') AS num FROM g)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) FILTER (num) AS n_numeric, CAST(sum(v) AS DOUBLE) AS total FROM v GROUP BY 1""")
def document_numbers(spark, d):
    w = _docs(spark, d).select("doc_id", F.explode(words_of("text")).alias("t")).where(F.col("t").rlike("[0-9]"))
    return plain(w.groupBy("doc_id").agg(F.count(F.when(N.is_numeric("t"), 1)).alias("n_numeric"), F.sum(N.clean_number("t")).alias("total")))


_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"


@query("printed_numbers", "T5 T6", f"""SELECT l_orderkey, l_partkey, l_suppkey, CAST(CASE l_linenumber WHEN 1 THEN {_PRICE} WHEN 2 THEN -{_PRICE} WHEN 3 THEN -{_PRICE}
  WHEN 4 THEN {_PRICE} WHEN 5 THEN 0 WHEN 6 THEN 0 ELSE {_PRICE} END AS DOUBLE) AS amount,
  CASE WHEN l_linenumber IN (5, 6, 7) THEN 0 ELSE CAST(trunc({_PRICE}) AS BIGINT) * CASE WHEN l_linenumber IN (2, 3) THEN -1 ELSE 1 END END AS whole,
  l_linenumber <= 4 AS is_number FROM lineitem""".replace("IN (5, 6, 7) THEN 0", "IN (5, 6) THEN 0"))
def printed_numbers(spark, d):
    """Prices printed seven ways: grouped, in brackets, minus behind, credit mark, as a date, broken, with a star."""
    li, k = render.table(spark, d, "lineitem"), F.col("l_linenumber")
    p = render.amount_text("l_extendedprice")
    shown = (F.when(k == 1, F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)).when(k == 2, F.concat(F.lit("("), p, F.lit(")")))
             .when(k == 3, F.concat(p, F.lit("-"))).when(k == 4, F.concat(p, F.lit("Cr"))).when(k == 5, F.lit("05-12-2024"))
             .when(k == 6, F.concat(F.lit("1."), p)).otherwise(F.concat(p, F.lit("*"))))
    t = li.withColumn("t", shown)
    return plain(t.select("l_orderkey", "l_partkey", "l_suppkey", N.clean_number("t").alias("amount"), N.clean_int("t").alias("whole"),
                          N.is_numeric("t").alias("is_number")))


# ------------------------------------------------------------------ line and entity texts

@query("normalised_lines", "T2", """SELECT p_partkey, 'ITEM' || p_size || '.500   CUSTOMER   QTY ' || p_size || '.25 ' || p_name || ' 12-05-24' AS line FROM part""")
def normalised_lines(spark, d):
    p = render.table(spark, d, "part")
    dirty = F.concat(F.lit(" ITEM"), F.col("p_size").cast("string"), F.lit(".50O == custmer --- QTY"),
                     F.col("p_size").cast("string"), F.lit(".25 "), F.col("p_name"), F.lit("(cid:7)12-05-24\x07"))
    return p.select("p_partkey", T.clean_line(dirty).alias("line"))


@query("healed_delimiters", "T1", "SELECT p_partkey, ' ' || p_name || '   ' || p_brand || '   1,234 ' AS line FROM part")
def healed_delimiters(spark, d):
    q = F.lit('"')
    return render.table(spark, d, "part").select("p_partkey", T.heal_delimiters(F.concat(
        q, "p_name", F.lit('","'), "p_brand", F.lit('",,"1,234"'))).alias("line"))


@query("store_spellings", "T7 T8", """SELECT c_custkey, 'C' || c_custkey || [' ENTERPRISES', ' MEDICALS', ' MEDICAL', ' PHARMA HALL', ' AGENCY'][c_custkey % 5 + 1] AS summary_name,
  'C' || c_custkey || [' ENTERPRISES', ' MEDICALS', ' MEDICAL', ' PHRM HALL', ' AGENCIES'][c_custkey % 5 + 1] AS field_name FROM customer""")
def store_spellings(spark, d):
    word = F.element_at(F.array(*[F.lit(w) for w in (" NTERPRISES", " MEDICLS", " ICAL", " PHRM HALL", " AGENCIES")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    c = render.table(spark, d, "customer").withColumn("t", F.concat(F.lit("C"), F.col("c_custkey").cast("string"), word))
    return c.select("c_custkey", T.fix_store_spelling("t").alias("summary_name"), T.fix_field_noise("t", "StoreName").alias("field_name"))


@query("known_products", "T9 T8", """SELECT p_partkey, ['ONECLAV 625 TAB.', 'LUPISULIDE-P TAB(AMB)', 'PANTOLUP DSR CAP', 'CEFPOLUP 200 TAB.', p_name || ' XIMECEFF'][p_partkey % 5 + 1] AS product FROM part""")
def known_products(spark, d):
    shown = F.element_at(F.array(F.lit("oneclav  625 tab"), F.lit("LUPISULIDE - P  TAB"), F.lit("PANTOLUP  DSR cap."), F.lit("cefpolup-200 tab"),
                                 F.concat("p_name", F.lit(" XIMECEFFF"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return render.table(spark, d, "part").select("p_partkey", T.fix_field_noise(shown, "Description").alias("product"))


@query("confused_letters", "T11", r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'),
  lambda x: x <> ''), lambda w: CASE WHEN regexp_matches(w, '^\p{Lu}\p{Ll}+$') THEN w ELSE translate(w, 'OlISBZsg', '01158259') END), ' ')) AS digest FROM documents""")
def confused_letters(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.fix_confused_letters("text")).alias("digest"))


@query("strict_entities", "T12", """SELECT c_custkey, 'CUSTOMER C' || c_custkey || ' & SONS - ' || c_mktsegment AS name, 'CUSTOMER C' || c_custkey || ' SONS - ' || c_mktsegment AS place FROM customer""")
def strict_entities(spark, d):
    t = F.concat(F.lit("--Customer.C"), F.col("c_custkey").cast("string"), F.lit(" & Sons -- 12-05-2024 ("), F.col("c_mktsegment"), F.lit(")"))
    c = render.table(spark, d, "customer").withColumn("t", t)
    return c.select("c_custkey", T.strict_entity("t").alias("name"), T.strict_entity(F.regexp_replace("t", "^--", ""), location=True).alias("place"))


@query("vendor_detection", "T14", """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, ['LUPIN', 'GENERIC', 'SKY', 'UNKNOWN', 'FLAT'][o_orderkey % 5 + 1] AS vendor FROM orders""")
def vendor_detection(spark, d):
    o = render.table(spark, d, "orders")
    body = F.element_at(F.array(*[F.lit(x) for x in ("Bill No 5 of LUPIN", "Tax Invoice", "sky pharma bill no", "plain text", "Party Name Product Qty")]),
                        (F.col("o_orderkey") % 5 + 1).cast("int"))
    lines = render.lines_of(o, F.col("o_orderkey"), F.lit(0), F.lit("first line"), body)
    return P.vendor_hint(lines)


@query("header_facts", "T15 T16 T17 T18 T4", """SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, translate(s_name, '0123456789', 'ABCDEFGHIJ') || ' TRADERS' AS agency_name,
  '29ABCDE1234F1Z5' AS gstin, '01-01-1995' AS from_date, '31-12-2001' AS to_date, 'BUSY ACCOUNTS' AS address FROM supplier""")
def header_facts(spark, d):
    facts = H.header_facts(render.delimited_statement(spark, d))
    return facts.select("doc_id", "agency_name", "gstin", "from_date", "to_date", "address")


@query("long_header_facts", "T15 T16 T17 T18 X32", """SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, translate(s_name, '0123456789', 'ABCDEFGHIJ') || ' TRADERS' AS agency_name,
  '29ABCDE' || s_suppkey || 'Z5' AS gstin, 'KA-' || s_suppkey AS tin, '080' || (1000000 + s_suppkey) AS phone, 'desk' || s_suppkey || '@example.com' AS email,
  'LUPIN ' || translate(s_name, '0123456789', 'ABCDEFGHIJ') AS company, 'RAVI ' || translate(s_name, '0123456789', 'ABCDEFGHIJ') AS customer,
  'MOHAN STORES' AS party, 'LAST ' || translate(s_name, '#0123456789', ' ABCDEFGHIJ') AS last_party, '01-04-1995' AS from_date, '31-03-1996' AS to_date,
  (SELECT string_agg('LANE ' || translate(k::VARCHAR, '0123456789', 'ABCDEFGHIJ'), ', ' ORDER BY k) FROM range(40) t(k)) || ', TIN NO : KA-' || s_suppkey AS address FROM supplier""")
def long_header_facts(spark, d):
    facts = H.header_facts(render.long_header_statement(spark, d))
    return facts.select("doc_id", "agency_name", "gstin", "tin", "phone", "email", "company", "customer", "party", "last_party", "from_date", "to_date", "address")


@query("header_views", "T3 T4", """SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 'SHARMATRADERS' AS first_line,
  contains('x', 'x') AS has_columns FROM nation""")
def header_views(spark, d):
    v = H.header_view(render.summary_report(spark, d))
    return v.select("doc_id", F.element_at("compact_lines", 1).alias("first_line"),
                    F.array_contains("compact_lines", "STORENAMESTORELOCATIONSALESRETURNAMOUNT").alias("has_columns"))


# ------------------------------------------------------------------ entities and items

@query("store_location_split", "E1 E2 E3", f"""WITH {SHOPS} SELECT c_custkey,
  [code || ' MEDICAL STORE', code, 'DR. ' || code || ' MBBS', code || ' KUMAR', code || ' KUMAR', code || ' PHARMACY'][c_custkey % 6 + 1] AS store_name,
  ['NEAR ' || place, place, place, place, '', ''][c_custkey % 6 + 1] AS store_location FROM shops""")
def store_location_split(spark, d):
    s = render.shops(spark, d)
    code, place = F.col("code"), F.col("place")
    t = F.element_at(F.array(
        F.concat(code, F.lit(" MEDICAL STORE NEAR "), place), F.concat(code, F.lit(", "), place, F.lit(" LUPIN LTD")),
        F.concat(F.lit("DR. "), code, F.lit(" MBBS "), place), F.concat(code, F.lit(" KUMAR-"), place), F.concat(code, F.lit(" KUMAR [x]")),
        F.concat(code, F.lit(" PHARMACY PVT LTD"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return E.split_store(s.withColumn("t", t), "t").select("c_custkey", "store_name", "store_location")


@query("item_parts", "E4", """SELECT p_partkey, upper(p_name) || ' TAB' AS brand, (p_size + 1) || 'MG' AS dosage, '10X10' AS packing FROM part""")
def item_parts(spark, d):
    t = F.concat("p_name", F.lit(" "), (F.col("p_size") + 1).cast("string"), F.lit("mg TAB 10x10 EXP"))
    return E.parse_description(render.table(spark, d, "part").withColumn("description", t)).select("p_partkey", "brand", "dosage", "packing")


@query("description_scrub", "E6", "SELECT p_partkey, p_name AS description FROM part")
def description_scrub(spark, d):
    t = F.concat(F.lit("3) RATE "), F.col("p_name"), F.lit(" AB123456 (old) 12-05-2024 JAN 25"))
    return render.table(spark, d, "part").select("p_partkey", E.scrub_glued(E.scrub_leading_token(E.scrub_description(t))).alias("description"))


@query("store_scrub", "E7", f"WITH {SHOPS} SELECT c_custkey, code || ' MEDICAL' AS name, place FROM shops")
def store_scrub(spark, d):
    s = render.shops(spark, d)
    name = F.concat(F.lit("A12-"), F.col("code"), F.lit(" MEDICAL (main) 12/05/2024 GST 29ABC"))
    place = F.concat(F.col("place"), F.lit(" MEDICAL HALL 12/05/2024"))
    return s.select("c_custkey", E.scrub_store_name(name).alias("name"), E.scrub_location(place).alias("place"))


@query("bill_rows", "E5", """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'PARTY BILL' AS description, '' AS brand FROM orders""")
def bill_rows(spark, d):
    o = render.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("line_no"),
                                                F.lit("BILL AMOUNT").alias("description"), F.col("o_totalprice").alias("amount"))
    return P.clean_descriptions(as_items(o, "SCHEMA_INFERRED")).select("doc_id", "description", "brand")


@query("reparent_stores", "E8 C7", f"""WITH {SALES}, n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM sales),
c AS (SELECT *, last_value(CASE WHEN seq = 1 THEN code END IGNORE NULLS) OVER w AS named, last_value(CASE WHEN seq = 1 THEN place END IGNORE NULLS) OVER w AS town
  FROM n WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, seq ROWS UNBOUNDED PRECEDING))
SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, CASE WHEN named IS NULL THEN 'UNKNOWN STORE' ELSE named || ' MEDICAL STORE' END AS store_name,
  coalesce(town, '') AS store_location, p_name AS description, CAST(l_quantity AS BIGINT) AS qty FROM c""")
def reparent_stores(spark, d):
    s = render.sales(spark, d)
    desc = F.when(F.col("seq") == 1, F.concat("shop", F.lit(" D "), "p_name")).otherwise(F.col("p_name"))
    items = as_items(s.select(F.col("l_suppkey").alias("doc_id"), F.col("pos").alias("line_no"), F.lit("UNKNOWN STORE").alias("store_name"),
                              F.lit("").alias("store_location"), desc.alias("description"), F.col("l_quantity").alias("qty")), "ANY")
    return P.reparent(items).select("doc_id", "store_name", "store_location", "description", "qty")


# ------------------------------------------------------------------ positioned tokens

_TOKENS = r"""WITH l AS (SELECT doc_id, i AS line, string_split(a[i + 1], ' ') AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(range(len(a))) u(i)),
t AS (SELECT doc_id, line, j AS word, w[j + 1] AS text FROM l, unnest(range(len(w))) v(j) WHERE regexp_matches(w[j + 1], '\S')),
k AS (SELECT *, ((doc_id * 31 + line * 7 + word * 13) % 70 + 30) / 100.0 AS confidence FROM t)"""


@query("tokens_to_rows", "C8", _TOKENS + """, r AS (SELECT doc_id, line, count(*) AS n FROM k WHERE confidence >= 0.45 GROUP BY 1, 2)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS row_no, n AS n_tokens FROM r""")
def tokens_to_rows(spark, d):
    placed = K.assign_rows(render.tokens(render.table(spark, d, "documents")))
    return placed.groupBy("doc_id", "row_no").agg(F.count("*").alias("n_tokens"))


@query("column_boundaries", "C9")
def column_boundaries(spark, d):
    return K.column_boundaries(render.tokens(render.table(spark, d, "documents")))


@query("row_texts", "C10 C9 C8")
def row_texts(spark, d):
    return K.row_texts(render.tokens(render.table(spark, d, "documents")))


@query("mean_token_confidence", "Q4", _TOKENS + """ SELECT CAST(doc_id AS VARCHAR) AS doc_id, round((sum(confidence * greatest(1, length(text)))
  / sum(greatest(1, length(text))))::DOUBLE, 6) AS mean_confidence FROM k GROUP BY 1""")
def mean_token_confidence(spark, d):
    c = K.mean_confidence(render.tokens(render.table(spark, d, "documents")))
    return c.select("doc_id", F.round("mean_confidence", 6).alias("mean_confidence"))
