"""Report corpora printed from the order tables, for round trips print -> read -> compare.

Every corpus is a `lines` frame (doc_id, page_no, line_no, text). Line numbers
are ordered positions, not consecutive. Nothing is gathered per document: header
and footer lines are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlift.session import staged

FOOT = 8_000_000_000_000_000_000
STEP = 10_000_000_000
BODY = 100
DIGITS, LETTERS = "0123456789", "ABCDEFGHIJ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def amount_text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)").cast("string")


def whole_text(c) -> Column:
    return F.col(c).cast("bigint").cast("string")


def lettered(c) -> Column:
    """A number or name with digits printed as letters."""
    return F.translate(c.cast("string"), DIGITS, LETTERS)


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with order, customer, nation and part; names ready for printing."""
    return _printable(_sold(spark, folder))


def written_sales(spark: SparkSession, folder: str) -> DataFrame:
    """As `sales`, joined once and written, for several readers."""
    return _printable(staged(_sold(spark, folder).drop("c_custkey", "c_mktsegment", "p_partkey", "o_orderkey", "code", "shop"), "sales"))


def _printable(sold: DataFrame) -> DataFrame:
    names = shop_names("o_custkey", F.col("place"))
    return sold.withColumns(names | {
        "pos": F.col("l_orderkey") * 1024 + F.col("seq"), "date": F.date_format("o_orderdate", "dd-MM-yyyy"),
        "qty": whole_text("l_quantity"), "free": (F.col("l_linenumber") % 3).cast("string"),
        "rate": amount_text("p_retailprice"), "amount": amount_text("l_extendedprice")})


def _sold(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with order, shop and part, numbered in their order.

    Lines are dealt out twice, by part while they are narrow and by order; the shops meet the orders before. Parts, orders and shops grow with
    the lines, so they are never broadcast, whatever their files' size suggests."""
    # line numbers repeat inside an order, so lines are numbered again: by order, on the order key of the join below
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                                 "l_extendedprice", "l_discount", "l_tax")
    od = with_shops(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), spark, folder)
    pt = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    return (
        li.join(pt.hint("shuffle_hash"), li.l_partkey == pt.p_partkey).join(od.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("seq", F.row_number().over(in_order))
    )


def shop_names(key: str, place: Column) -> dict[str, Column]:
    code = F.concat(F.lit("C"), F.col(key).cast("string"))
    return {"code": code, "shop": F.concat(code, F.lit(" MEDICAL STORE, "), place)}


def shops(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as shops: code, printed name, place."""
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey", "c_nationkey", "c_mktsegment", lettered(F.col("n_name")).alias("place")).withColumns(shop_names("c_custkey", F.col("place")))


def with_shops(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Rows that have an o_custkey with the columns of their shop."""
    return df.join(shops(spark, folder).hint("merge"), F.col("o_custkey") == F.col("c_custkey"))


def order_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Shops with the total of their orders."""
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    return with_shops(o, spark, folder).drop("o_custkey")


def lines_of(df: DataFrame, doc, pos, *texts, page=0) -> DataFrame:
    """One output line per given text, in order, at consecutive positions; null texts print nothing."""
    page = page if isinstance(page, Column) else F.lit(page)
    if len(texts) == 1:
        out = df.select(doc.cast("string").alias("doc_id"), page.cast("int").alias("page_no"),
                        pos.cast("bigint").alias("line_no"), texts[0].alias("text"))
    else:
        arr = F.array(*[F.struct(F.lit(i).alias("i"), t.alias("t")) for i, t in enumerate(texts)])
        out = df.select(doc.cast("string").alias("doc_id"), page.cast("int").alias("page_no"), pos.alias("p"),
                        F.explode(arr).alias("x")) \
            .select("doc_id", "page_no", (F.col("p") + F.col("x.i")).cast("bigint").alias("line_no"), F.col("x.t").alias("text"))
    return out.where(F.col("text").isNotNull())


def header_of(docs: DataFrame, doc, *texts) -> DataFrame:
    return lines_of(docs, doc, F.lit(0), *[t if isinstance(t, Column) else F.lit(t) for t in texts])


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def totals_line(df: DataFrame, doc, value, label: str = "GRAND TOTAL ", sep: str = "") -> DataFrame:
    t = df.groupBy(doc.cast("string").alias("d")).agg(F.sum(value).alias("v"))
    return lines_of(t, F.col("d"), F.lit(FOOT), F.concat(F.lit(label), F.lit(sep), amount_text("v")))


# ------------------------------------------------------------------ delimited and flat statements

def delimited_statement(spark: SparkSession, folder: str, sold: DataFrame | None = None) -> DataFrame:
    """One tab-separated party and product statement per supplier, with sub-total and grand total."""
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    d = sold or sales(spark, folder)
    doc = F.col("l_suppkey")
    body = lines_of(d, doc, F.col("pos") + BODY, F.concat_ws(
        "\t", "shop", "p_name", F.concat(F.lit("1*"), (F.col("p_size") + 1).cast("string")), "qty", "free", "rate", "amount",
        amount_text("l_discount"), amount_text("l_tax")))
    head = header_of(s, F.col("s_suppkey"), "BUSY ACCOUNTS",
                     F.concat(lettered(F.col("s_name")), F.lit(" TRADERS")), "GSTIN : 29ABCDE1234F1Z5",
                     "PARTY WISE PRODUCT WISE SALES 01-01-1995 TO 31-12-2001",
                     "PARTY NAME\tPRODUCT\tPACKING\tQTY\tFREE\tRATE\tAMOUNT\tDISCOUNT\tTAX")
    value = F.col("l_extendedprice").cast("decimal(18,2)")
    li = table(spark, folder, "lineitem")
    sub = totals_line(li, doc, value, "SUB TOTAL", "\t").withColumn("line_no", F.lit(FOOT - 1))
    return union(head, body, sub, totals_line(li, doc, value, "GRAND TOTAL", "\t"))


def long_header_statement(spark: SparkSession, folder: str) -> DataFrame:
    """A statement per supplier whose table opens at line 60 or below, its facts from line 45 on, and other such facts inside the table."""
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    name, key = lettered(F.col("s_name")), F.col("s_suppkey").cast("string")
    lanes = [F.concat(F.lit("LANE "), lettered(F.lit(str(k)))) for k in [*range(40), 3, 7, 3]]
    facts = [F.concat(F.lit("GSTIN : 29ABCDE"), key, F.lit("Z5")), F.concat(F.lit("TIN NO : KA-"), key),
             F.concat(F.lit("Phone : 080"), (F.col("s_suppkey") + 1000000).cast("string")),
             F.concat(F.lit("E-Mail : desk"), key, F.lit("@example.com")), F.lit("M/S MOHAN STORES"), F.lit("Page 1"),
             F.concat(F.lit("Company : LUPIN "), name), F.lit("PERIOD 31-03-1996 TO 01-04-1995"), F.lit("LANE BELOW THE PERIOD")]
    inside = [F.lit("GSTIN : WRONG"), F.lit("Phone : 999"), F.lit("Company : WRONG"), F.lit("05-05-2005 row"),
              F.concat(F.lit("CUSTOMER : RAVI "), name, F.lit(", PLACE")), F.concat(F.lit("M/S LAST "), name), F.lit("M/S NORTH AGENCY")]
    head = header_of(s, F.col("s_suppkey"), F.concat(name, F.lit(" TRADERS")), *lanes, *facts, *[F.lit("=====")] * 8, "PARTY NAME\tPRODUCT\tQTY\tAMOUNT")
    li = table(spark, folder, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    body = lines_of(li, F.col("s_suppkey"), F.lit(BODY) + F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.concat_ws(
        "\t", F.lit("SHOP"), F.col("l_partkey").cast("string"), whole_text("l_quantity"), amount_text("l_extendedprice")))
    return union(head, lines_of(s, F.col("s_suppkey"), F.lit(80), *inside), body)


# Product words the flat layout is recognised by.
FLAT_PRODUCTS = ["HEPP FORT SYP", "ONECLAV 625 TAB", "DEFENAC GEL", "REVEAL KIT", "MEGARICH CAP", "CIPROVA 500"]


def flat_statement(spark: SparkSession, folder: str, sold: DataFrame | None = None) -> DataFrame:
    """One flat ten-column statement per supplier. Lines with an even line number leave the store cells empty."""
    d = sold or sales(spark, folder)
    product = F.element_at(F.array(*[F.lit(p) for p in FLAT_PRODUCTS]), (F.col("l_partkey") % 6 + 1).cast("int"))
    shown = F.col("l_linenumber") % 2 == 1
    body = lines_of(d, F.col("l_suppkey"), F.col("pos") + BODY, F.concat_ws(
        "\t", F.concat(F.col("c_nationkey").cast("string"), F.lit(" "), F.col("place")),
        F.when(shown, F.col("code")).otherwise(""), F.when(shown, F.lit("MEDICALS")).otherwise(""), product, F.lit("10*10"),
        "qty", "free", "rate", "amount", F.lit("LUPIN")))
    li = table(spark, folder, "lineitem")
    return union(body, totals_line(li, F.col("l_suppkey"), F.col("l_extendedprice").cast("decimal(18,2)"), "GRAND TOTAL", "\t"))


def flat_reader_statement(spark: SparkSession, folder: str) -> DataFrame:
    """One flat table per nation: an area line, a header, then store rows each followed by product rows."""
    d = sales(spark, folder)
    s = shops(spark, folder)
    doc = F.col("c_nationkey")
    store = F.concat(F.lit("Shop "), lettered(F.col("c_custkey")), F.lit(" Medical, "),
                     F.replace(F.col("place"), F.lit("_"), F.lit(" ")), F.lit(" Road"))
    n = table(spark, folder, "nation")
    head = header_of(n, F.col("n_nationkey"), F.concat(F.lit("Area : Zone "), lettered(F.col("n_regionkey"))),
                     "Product Qty Free Rate Amount")
    stores = lines_of(s, doc, F.col("c_custkey") * STEP + BODY, store)
    body = lines_of(d, doc, F.col("c_custkey") * STEP + F.col("pos") + BODY + 1, F.concat_ws(" ", "p_name", "qty", "free", "rate", "amount"))
    tail = lines_of(n, F.col("n_nationkey"), F.lit(FOOT), F.lit("Grand Total : 1.00"))
    return union(head, stores, body, tail)


# ------------------------------------------------------------------ summaries per nation

def summary_report(spark: SparkSession, folder: str) -> DataFrame:
    """Store totals per nation under segment headings; every fifth name wraps over two lines."""
    t = order_totals(spark, folder)
    doc, seg = F.col("c_nationkey"), F.ascii("c_mktsegment")
    pos = seg * STEP + F.col("c_custkey") * 4 + BODY
    wraps = F.col("c_custkey") % 5 == 0
    serial = (F.col("c_custkey") % 900 + 1).cast("string")
    body = lines_of(t, doc, pos, F.when(wraps, F.concat(F.col("code"), F.lit(" MEDICAL"))),
                    F.when(wraps, F.concat_ws(" ", F.lit("STORE,"), "place", amount_text("total")))
                    .otherwise(F.concat_ws(" ", serial, "shop", amount_text("total"))))
    areas = lines_of(t.select("c_nationkey", "c_mktsegment").distinct(), doc, seg * STEP,
                     F.concat(F.lit("7 "), F.col("c_mktsegment"), F.lit(" ZONE")))
    head = header_of(table(spark, folder, "nation"), F.col("n_nationkey"), "SHARMA TRADERS", "STATION ROAD",
                     "01-01-1995 TO 31-12-2001", "STORENAME STORE LOCATION SALES RETURN AMOUNT")
    return union(head, areas, body, totals_line(t, doc, F.col("total")))


def wrapped_report(spark: SparkSession, folder: str) -> DataFrame:
    """Store totals per nation whose names run over long lines: text of more than 80 characters waits before each total, and at the end."""
    t = order_totals(spark, folder)
    doc, pos = F.col("c_nationkey"), F.col("c_custkey") * 8 + BODY
    first = F.concat(F.col("code"), F.lit(" GOODS OF THE FIRST CLASS AND SERVICES FOR EVERY HOUSE"))
    body = lines_of(t, doc, pos, first, F.concat(F.lit("SINCE THE LAST FIVE AND TWENTY YEARS MEDICAL STORE, "), F.col("place")), F.lit("AND"),
                    F.lit("NEW"), F.concat(F.col("code"), F.lit(" MEDICAL")), F.concat_ws(" ", F.lit("STORE,"), "place", amount_text("total")))
    head = header_of(table(spark, folder, "nation"), F.col("n_nationkey"), "SHARMA TRADERS", "STATION ROAD",
                     "01-01-1995 TO 31-12-2001", "STORENAME STORE LOCATION SALES RETURN AMOUNT")
    return union(head, body, totals_line(t, doc, F.col("total")))


def quarterly_report(spark: SparkSession, folder: str) -> DataFrame:
    """Three period amounts and their total per store; odd nations print the total first."""
    o = table(spark, folder, "orders")
    v = F.col("o_totalprice").cast("decimal(18,2)")
    m = [F.coalesce(F.sum(F.when(F.month("o_orderdate") % 3 == k, v)), F.lit(0).cast("decimal(18,2)")).alias(f"m{k}") for k in range(3)]
    t = with_shops(o.groupBy("o_custkey").agg(*m, F.sum(v).alias("total")), spark, folder)
    parts = [amount_text(f"m{k}") for k in range(3)]
    first = F.col("c_nationkey") % 2 == 1
    body = lines_of(t, F.col("c_nationkey"), F.col("c_custkey") + BODY, F.when(
        first, F.concat_ws(" ", "shop", amount_text("total"), *parts)).otherwise(F.concat_ws(" ", "shop", *parts, amount_text("total"))))
    order = F.when(F.col("n_nationkey") % 2 == 1, "STORE NAME TOTAL JAN FEB MAR").otherwise("STORE NAME JAN FEB MAR TOTAL")
    head = header_of(table(spark, folder, "nation"), F.col("n_nationkey"), "SHARMA TRADERS", "QUARTERLY", order)
    return union(head, body)


def maker_report(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity, free, gross and net per store behind the maker's name."""
    t = order_totals(spark, folder)
    body = lines_of(t, F.col("c_nationkey"), F.col("c_custkey") + BODY, F.concat_ws(
        " ", F.lit("ALPHA"), "shop", F.lit("5 2"), amount_text(F.col("total") / 2), amount_text("total")))
    head = header_of(table(spark, folder, "nation"), F.col("n_nationkey"), "SHARMA TRADERS", "COMPANY : ALPHA LABS",
                     "GROUP/CUSTOMER QTY FREE GROSS VAL NET VALUE")
    return union(head, body)


def analysis_report(spark: SparkSession, folder: str) -> DataFrame:
    t = order_totals(spark, folder)
    body = lines_of(t, F.col("c_nationkey"), F.col("c_custkey") + BODY, F.concat(
        F.col("c_custkey").cast("string"), F.lit("."), F.col("shop"), F.lit(" "), amount_text("total")))
    head = header_of(table(spark, folder, "nation"), F.col("n_nationkey"), "SHARMA TRADERS", "SALES ANALYSIS",
                     "FOR ALL PARTIES", "STORE NAME AND VALUE")
    return union(head, body)


def amount_first_book(spark: SparkSession, folder: str) -> DataFrame:
    """The amount, the name, and the place on the next line."""
    t = order_totals(spark, folder)
    body = lines_of(t, F.col("c_nationkey"), F.col("c_custkey") * 4 + BODY,
                    F.concat_ws(" ", amount_text("total"), "code", F.lit("MEDICAL STORE,")), F.col("place"))
    head = header_of(table(spark, folder, "nation"), F.col("n_nationkey"), "SHARMA TRADERS", "AMOUNT STORE NAME")
    return union(head, body, totals_line(t, F.col("c_nationkey"), F.col("total")))


def two_column_report(spark: SparkSession, folder: str) -> DataFrame:
    """Bills of one customer: a label and an amount."""
    o = table(spark, folder, "orders")
    s = shops(spark, folder)
    body = lines_of(o, F.col("o_custkey"), F.col("o_orderkey") + BODY, F.concat_ws(
        " ", F.lit("BILL"), lettered(F.col("o_orderkey")), amount_text("o_totalprice")))
    head = header_of(s, F.col("c_custkey"), "SHARMA TRADERS", F.concat(F.lit("CUSTOMER : "), F.col("code"), F.lit(" MEDICAL STORE")),
                     "BILL NO STORE NAME AMOUNT DISCOUNT NET AMT TAX PAYABLE DR/CR")
    return union(head, body)


# ------------------------------------------------------------------ registers

def _by_shop(spark: SparkSession, folder: str, row, *header, heading=None, sold: DataFrame | None = None) -> DataFrame:
    """One report per nation: a shop heading, then that shop's order lines. sold: the `sales`, if they are joined already."""
    d, s = sold or sales(spark, folder), shops(spark, folder)
    doc = F.col("c_nationkey")
    names = lines_of(s, doc, F.col("c_custkey") * STEP + BODY, heading if heading is not None else F.col("shop"))
    body = lines_of(d, doc, F.col("o_custkey") * STEP + F.col("pos") + BODY + 1, row)
    return union(header_of(table(spark, folder, "nation"), F.col("n_nationkey"), *header), names, body)


def itemised_register(spark: SparkSession, folder: str, sold: DataFrame | None = None) -> DataFrame:
    row = F.concat_ws(" ", "date", F.concat(F.lit("B"), F.col("l_orderkey").cast("string")), "p_name", "qty", "free", "rate", "amount")
    return _by_shop(spark, folder, row, "SHARMA TRADERS", "DATE BILLNO ITEM BATCH NO QTY FREE SALE PR AMOUNT EXP.DATE", sold=sold)


def partywise_register(spark: SparkSession, folder: str, sold: DataFrame | None = None) -> DataFrame:
    row = F.concat_ws(" ", "date", F.concat(F.lit("R"), F.col("l_orderkey").cast("string")), "p_name", "qty", "free", "rate", "amount")
    return _by_shop(spark, folder, row, "SHARMA TRADERS", "DATE BILL REF PRODUCT PACK QTY FREE AMOUNT", sold=sold)


def customer_products(spark: SparkSession, folder: str, netted: bool = False, sold: DataFrame | None = None) -> DataFrame:
    row = F.concat_ws(" ", "p_name", "qty", "free", "amount", *([F.lit("0.50")] if netted else []))
    title = "CUSTOMER WISE PRODUCT WISE" if netted else "CUSTOMER COMPANY AND PRODUCT SALES"
    return _by_shop(spark, folder, row, "SHARMA TRADERS", title, "PRODUCT NAME QTY FREE AMOUNT", sold=sold)


def party_products(spark: SparkSession, folder: str, sold: DataFrame | None = None) -> DataFrame:
    row = F.concat_ws(" ", "p_name", F.lit("10ML"), "qty", "free", "amount", amount_text("l_discount"))
    return _by_shop(spark, folder, row, "SHARMA TRADERS",
                    "SERIAL NO PRODUCT CODE BRAND NAME QTY PRICE FREE UNITS AMOUNT DISCOUNT", sold=sold)


def party_items(spark: SparkSession, folder: str, sold: DataFrame | None = None) -> DataFrame:
    rate = amount_text(F.col("l_extendedprice") / F.col("l_quantity"))
    row = F.concat_ws(" ", "p_name", "qty", "free", rate, "amount")
    return _by_shop(spark, folder, row, "SHARMA TRADERS", "PARTY ITEM", "PRODUCT QTY FREE RATE AMOUNT", sold=sold)


def item_stores(spark: SparkSession, folder: str, sold: DataFrame | None = None) -> DataFrame:
    """Per supplier: a product heading, then '-STORE' rows."""
    d = sold or staged(sales(spark, folder).select("l_suppkey", "l_partkey", "p_name", "pos", "code", "qty", "amount"), "sales")  # read twice
    doc = F.col("l_suppkey")
    heads = lines_of(d.select("l_suppkey", "l_partkey", "p_name").distinct(), doc, F.col("l_partkey") * STEP + BODY,
                     F.concat_ws(" ", "p_name", F.lit("KIT 45.00")))
    rows = lines_of(d, doc, F.col("l_partkey") * STEP + F.col("pos") + BODY + 1, F.concat(
        F.lit("-"), F.col("code"), F.lit(" PHARMACY "), F.col("qty"), F.lit(" "), F.col("amount")))
    head = header_of(table(spark, folder, "supplier"), F.col("s_suppkey"), "SHARMA TRADERS",
                     "PRODUCT CODE PRODUCT NAME PACKING QTY VALUE")
    return union(head, heads, rows)


# ------------------------------------------------------------------ bills and invoices

def _cents(k: int) -> Column:
    """Small amounts that differ by order: (key * k mod 1000) / 100."""
    return ((F.col("o_orderkey") * k) % 1000).cast("decimal(18,2)") / F.lit(100)


def sales_book(spark: SparkSession, folder: str) -> DataFrame:
    """One sales book per month with six tax columns; every tenth bill number has no letters."""
    o = table(spark, folder, "orders").withColumn("doc", F.date_format("o_orderdate", "yyyy-MM"))
    bill = F.lpad(F.col("o_orderkey").cast("string"), 6, "0")
    no = F.when(F.col("o_orderkey") % 10 == 0, bill).otherwise(F.concat(F.lit("AB"), bill))
    body = lines_of(o, F.col("doc"), F.col("o_orderkey") + BODY, F.concat_ws(
        " ", F.date_format("o_orderdate", "dd-MM-yyyy"), no, F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(" MEDICAL STORE")),
        amount_text("o_totalprice"), *[amount_text(_cents(k)) for k in (3, 7, 11, 13, 17, 19)]))
    head = header_of(o.select("doc").distinct(), F.col("doc"), "SHARMA TRADERS", "SALES BOOK", "GSTIN : 29ABCDE1234F1Z5",
                     "DATE BILL NO PARTY NAME BILL AMT TAXABLE TAX SUR TAX FREE EXEMPTED R.OFF")
    return union(head, body, totals_line(o, F.col("doc"), F.col("o_totalprice").cast("decimal(18,2)"), "TOTAL : "))


def paged_invoices(spark: SparkSession, folder: str) -> DataFrame:
    """One document per customer, one page per order."""
    # read by items and orders, and the orders by the top and the end of their page: each is computed once
    d = staged(sales(spark, folder).select("l_orderkey", "o_custkey", "o_orderdate", "code", "place", "l_extendedprice", "seq", "l_linenumber", "p_name",
                                           "l_partkey", "qty", "rate", "amount"), "sales")
    per = staged(d.groupBy("l_orderkey", "o_custkey", "o_orderdate", "code", "place").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("sub")), "pages")
    key = F.col("l_orderkey") * STEP
    page = F.col("l_orderkey").cast("int")
    tax = ((F.col("l_orderkey") * 7) % 1000 + 1).cast("decimal(18,2)") / F.lit(100)
    top = lines_of(per, F.col("o_custkey"), key, F.lit("GST NO : 29ABCDE1234F1Z5"),
                   F.concat(F.lit("M/S "), F.col("code"), F.lit(" MEDICAL STORE INVOICE NO. : "), F.col("l_orderkey").cast("string")),
                   F.concat(F.replace(F.col("place"), F.lit("_"), F.lit(" ")), F.lit(" DATE : "), F.date_format("o_orderdate", "dd/MM/yyyy"),
                            F.lit(" NO OF CASES : 3")),
                   F.lit("SL ITEM DESCRIPTION PACK EXPIRY BATCH C/B QTY+FR MRP RATE GST AMOUNT HSNCODE"), page=page)
    body = lines_of(d, F.col("o_custkey"), key + BODY + F.col("seq"), F.concat_ws(
        " ", F.col("l_linenumber").cast("string"), "p_name", F.lit("10X10 JAN25"), F.concat(F.lit("B"), F.col("l_partkey").cast("string")),
        F.lit("2 BOX"), "qty", F.lit("12.50"), "rate", F.lit("5.00%"), "amount", F.lit("30049099")), page=page)
    end = lines_of(per, F.col("o_custkey"), key + BODY * 1000, F.concat(F.lit("Sub total : "), amount_text("sub")),
                   F.concat(F.lit("ADD GST : "), amount_text(tax)), F.lit("Round off : 0.40"),
                   F.concat(F.lit("Total Balance : "), amount_text(F.col("sub") + tax + F.lit(0.40).cast("decimal(18,2)"))), page=page)
    return union(top, body, end)


def tax_invoices(spark: SparkSession, folder: str, sold: DataFrame | None = None) -> DataFrame:
    """One tax invoice per order."""
    d = sold or sales(spark, folder)
    body = lines_of(d, F.col("l_orderkey"), F.col("seq") + BODY, F.concat_ws(
        " ", F.concat(F.col("l_linenumber").cast("string"), F.lit(".")), "qty", F.lit("10TAB"),
        "p_name", F.lit("CAP"), F.concat(F.lit("K"), F.col("l_partkey").cast("string")), F.lit("12/26"), F.lit("30049099"),
        F.lit("12.50"), "rate", amount_text("l_discount"), amount_text("l_tax"), amount_text("l_tax"), "amount"))
    o = table(spark, folder, "orders")
    head = header_of(o, F.col("o_orderkey"), "SHARMA DISTRIBUTORS", F.concat(
        F.lit("M/S C"), F.col("o_custkey").cast("string"), F.lit(" MEDICAL STORE, DATE : "), F.date_format("o_orderdate", "dd-MM-yyyy")),
        "Sn. Qty. Pack Product Batch Exp. HSN MRP Rate Disc SGST CGST Amount", "TOTAL B/F 0.00")
    return union(head, body, lines_of(o, F.col("o_orderkey"), F.lit(FOOT), F.lit("GRAND TOTAL 1.00")))


def broken_tax_invoices(spark: SparkSession, folder: str) -> DataFrame:
    """One tax invoice per customer. Every row is broken behind its tax code; its numbers stand on the page after."""
    title = "Sn. Qty. Pack Product Batch Exp. HSN MRP Rate Disc SGST CGST Amount"
    front = F.concat_ws(" ", F.concat(F.col("seq").cast("string"), F.lit(".")), "qty", F.lit("10TAB"), "p_name", F.lit("CAP"),
                        F.concat(F.lit("K"), F.col("l_partkey").cast("string")), F.lit("12/26"), F.lit("30049099"))
    back = F.concat_ws(" ", F.lit("12.50"), "rate", amount_text("l_discount"), amount_text("l_tax"), amount_text("l_tax"), "amount")
    rows = sales(spark, folder).select(F.col("o_custkey").cast("string").alias("doc_id"), "pos", F.posexplode(
        F.array(F.lit(title), front, F.lit(title), back)).alias("at", "text"))
    line = F.col("pos") * 4 + F.col("at")
    return rows.select("doc_id", F.floor(line / 2).cast("bigint").alias("page_no"), line.alias("line_no"), "text")


def single_invoices(spark: SparkSession, folder: str, sold: DataFrame | None = None) -> DataFrame:
    """One invoice per order: item rows, a discount line, then a tax block that closes the table."""
    d = sold or sales(spark, folder)
    body = lines_of(d, F.col("l_orderkey"), F.col("seq") + BODY, F.concat_ws(
        " ", F.concat(F.col("l_linenumber").cast("string"), F.lit(".")), "qty", "p_name", "rate", "amount"))
    o = table(spark, folder, "orders")
    head = header_of(o, F.col("o_orderkey"), "SHARMA DISTRIBUTORS", "TAX INVOICE", F.concat(
        F.lit("M/S C"), F.col("o_custkey").cast("string"), F.lit(" MEDICAL STORE, DATE : "), F.date_format("o_orderdate", "dd-MM-yyyy")),
        "SL QTY PRODUCT HSN MRP RATE AMOUNT")
    disc = amount_text(((F.col("o_orderkey") * 7) % 1000 + 1).cast("decimal(18,2)") / F.lit(100))
    tail = lines_of(o, F.col("o_orderkey"), F.lit(FOOT), F.concat(F.lit("CASH DISCOUNT "), disc), F.lit("TAX DETAILS"),
                    F.lit("ITEM AFTER THE TABLE 10.00 20.00"))
    return union(head, body, tail)


# ------------------------------------------------------------------ fixed-width registers

def wide_register(spark: SparkSession, folder: str) -> DataFrame:
    """Register with a party column, one per month."""
    o = table(spark, folder, "orders").withColumn("doc", F.date_format("o_orderdate", "yyyy-MM"))
    body = lines_of(o, F.col("doc"), F.col("o_orderkey") + BODY, F.concat_ws(
        "  ", F.date_format("o_orderdate", "dd-MM-yyyy"), F.concat(F.lit("AB"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(" MEDICAL STORE")), amount_text("o_totalprice"),
        amount_text(_cents(3)), amount_text(_cents(7))))
    head = header_of(o.select("doc").distinct(), F.col("doc"), "SHARMA TRADERS", "----------",
                     "DATE        BILL NO   PARTY NAME            BILL AMT     TAXABLE   TAX")
    return union(head, body, totals_line(o, F.col("doc"), F.col("o_totalprice").cast("decimal(18,2)"), "GRAND TOTAL "))


def column_register(spark: SparkSession, folder: str) -> DataFrame:
    """Register cut at column positions, shop headings between the rows."""
    pad = lambda c, n: F.rpad(c, n, " ")
    row = F.concat(pad(F.col("date"), 12), pad(F.concat(F.lit("B"), F.col("l_orderkey").cast("string")), 12), pad(F.col("p_name"), 24),
                   pad(F.col("qty"), 6), pad(F.col("rate"), 12), F.col("amount"))
    title = "DATE        BILL NO     ITEM NAME               QTY   RATE        AMOUNT"
    return _by_shop(spark, folder, row, "SHARMA TRADERS", "==========", title,
                    heading=F.concat(F.lit("M/S "), F.col("code"), F.lit(" MEDICAL STORE")))


# ------------------------------------------------------------------ positioned tokens

def tokens(documents: DataFrame) -> DataFrame:
    """Words of documents as positioned tokens: a line every 30 units, a character every 8, slight jitter by position."""
    words = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")) \
        .select("doc_id", "line", F.posexplode(F.split("t", " ")).alias("word", "text")).where(F.col("text").rlike(r"\S"))
    k = F.col("doc_id") * 31 + F.col("line") * 7 + F.col("word") * 13
    x, y = F.col("word") * 90.0, F.col("line") * 30.0 + (k % 7)
    width = F.length("text") * 8.0
    return words.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page_no"), "line", "word", "text",
        ((k % 70 + 30) / 100.0).alias("confidence"), y.alias("center_y"), (y - 6).alias("y_min"), (y + 6).alias("y_max"),
        x.alias("min_x"), (x + width).alias("max_x"), F.lit(12.0).alias("height"), F.lit(8.0).alias("char_width"))
