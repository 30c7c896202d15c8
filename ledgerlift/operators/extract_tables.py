"""Tables to items: delimited rows, flat rows, sales books, paged and tax invoices, and columns inferred from a header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift import layouts as L
from ledgerlift import lexicon as X
from ledgerlift.functions.common import first_group, has_any, let, match_groups, money, settle, squeeze, strip, words_of
from ledgerlift.functions.entities import split_store
from ledgerlift.functions.numbers import (
    clean_int, clean_number, date_key, fix_flat_digits, flat_number, number_after,
)
from ledgerlift.functions.text import clean_line, compact, expand_abbreviations
from ledgerlift.operators.extract_rows import as_items
from ledgerlift.operators.joined_rows import TAX_ROW, joined_rows, table_lines
from ledgerlift.operators.ordered import KEY_ROWS, attach, scan

UNKNOWN_STORE = "UNKNOWN STORE"


def _clean_lines(lines: DataFrame) -> DataFrame:
    """Lines with their cleaned text `t`; blank lines and rulers leave."""
    return settle(lines, F.struct(clean_line("text").alias("t")),
                  lambda v: (v["t"] != "") & ~v["t"].rlike(r"^-+$") & ~v["t"].startswith("---")).drop("text")


# ------------------------------------------------------------------ delimited rows

def delimited_rows(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Every line of a delimited report as the 16 logical fields plus its row type. formats: doc_id, format_id."""
    df = attach(lines.select("doc_id", "line_no", "text"), formats.select("doc_id", "format_id"), ["doc_id"], "line_no",
                how="inner")
    # settled: filters on these columns must not make the text and its cells again, in the join and once per field
    df = settle(df, F.struct(strip("text").alias("t")), lambda v: v["t"] != "").withColumn("cells", F.split("t", "\t"))
    t = F.col("t")

    def field(name: str) -> Column:
        at = F.lit(None).cast("int")
        for s in L.DELIMITED:
            if name in s["columns"]:
                at = F.when(F.col("format_id") == s["format_id"], F.lit(s["columns"][name])).otherwise(at)
        return F.coalesce(strip(F.get("cells", at)), F.lit(""))

    subtotal = reduce(lambda a, b: a | b, [(F.col("format_id") == s["format_id"]) & t.rlike(s["subtotal"])
                                           for s in L.DELIMITED])
    kind = F.when(t.rlike(L.GRAND_TOTAL), "grand_total").when(subtotal, "subtotal").otherwise("data")
    chosen_by = ["party_name", "product_name", "amount"]
    df = settle(df, F.struct(kind.alias("row_type"), *[field(f).alias(f) for f in chosen_by]))
    return df.select("doc_id", "line_no", "format_id", "row_type", *[F.col(f) if f in chosen_by else field(f).alias(f) for f in L.FIELDS])


def delimited_items(lines: DataFrame, formats: DataFrame, subtotals: bool = False, unpriced: bool = False,
                    party_as_store: bool = False) -> DataFrame:
    """Items of delimited reports.

    Subtotal lines would count amounts twice, and title lines carry no number in
    the amount column; both are left out unless asked for.
    """
    rows = delimited_rows(lines, formats)
    keep = F.col("row_type") != "grand_total" if subtotals else F.col("row_type") == "data"
    priced = F.lit(True) if unpriced else F.col("amount").rlike(r"^[-(]?[\d.,]*\d[\d.,]*[-)]?$")
    desc = F.coalesce(F.nullif("product_name", F.lit("")), F.nullif("party_name", F.lit("")))
    rows = rows.where(keep & priced & desc.isNotNull())
    store = F.coalesce(F.nullif("party_name", F.lit("")), F.lit(UNKNOWN_STORE)) if party_as_store else F.lit(UNKNOWN_STORE)
    return as_items(rows.withColumns({
        "description": desc, "store_name": store, "store_location": F.lit(""),
        "qty": clean_int("qty"), "free": clean_int("free_qty"), "rate": clean_number("rate"),
        "amount": clean_number("amount"), "percent": money(F.lit(0)), "bill_no": F.lit(None).cast("string")}), "DELIMITED")


# ------------------------------------------------------------------ flat party-product rows

def flat_items(lines: DataFrame, stems=None, three_cell_stores: list[str] | None = None) -> DataFrame:
    """Flat rows: store in the first cell, or city and a store over two cells (three for the names given).

    Rate and amount are the last two amounts; rows without a store take the store of the row before.
    """
    drug = X.stem_pattern(stems or X.STEMS_FLAT_ROW)
    amt = r"\b\d{1,7}\.\d{2}\b"
    # settled: filters on these columns must not make them again
    df = settle(lines.select("doc_id", "line_no", "text"), F.struct(fix_flat_digits(strip("text")).alias("t")),
                lambda v: (v["t"] != "") & ~v["t"].rlike(r"(?i)\b(GRAND\s*TOTAL|END\s*OF\s*REPORT)\b")).drop("text")
    df = settle(df, F.struct(F.transform(F.split("t", "\t"), lambda v: strip(v)).alias("c")), lambda v: F.size(v["c"]) >= 3)
    cell = lambda i: F.coalesce(F.get("c", i if isinstance(i, Column) else F.lit(i)), F.lit(""))
    col0_store = cell(0).rlike(X.FLAT_STORE_WORD) & ~cell(0).rlike(r"^\d")
    joined3 = F.array_join(F.slice("c", 2, 3), " ")
    wide = F.lit(False)
    if three_cell_stores:
        wide = ~col0_store & (F.size("c") >= 4) & has_any(F.upper(joined3), [s.upper() for s in three_cell_stores])
    df = df.withColumn("shape", F.when(col0_store, 1).when(wide, 4).otherwise(3))   # index of the product cell
    city = F.when(F.col("shape") == 1, "").otherwise(strip(F.regexp_replace(cell(0), r"^[\d\s]+", "")))
    store = F.when(F.col("shape") == 1, cell(0)).when(F.col("shape") == 4, joined3) \
        .otherwise(strip(F.concat_ws(" ", cell(1), cell(2))))
    ext = F.when(F.col("shape") == 1, 2).otherwise(4)
    product = cell(F.col("shape"))
    both = strip(F.concat_ws(" ", product, cell(ext)))
    df = df.withColumns({
        "city": city, "store": store,
        "product": F.when(~product.rlike(drug) & (F.size("c") > ext) & both.rlike(drug), both).otherwise(product),
        "packs": F.slice("c", F.col("shape") + 2, F.lit(3)),
        "q": cell(F.col("shape") + 2), "f": cell(F.col("shape") + 3),
        "last_two": F.regexp_extract_all(F.try_element_at("c", F.lit(-1)), F.lit(amt), F.lit(0)),
        "all2": F.regexp_extract_all("t", F.lit(amt), F.lit(0)),
        "all3": F.regexp_extract_all("t", F.lit(r"\b\d{1,7}\.\d{3}\b"), F.lit(0)),
    })
    pair = F.array_sort(F.transform(F.slice("last_two", F.greatest(F.size("last_two") - 1, F.lit(1)), F.lit(2)), flat_number))
    a_last, a_prev = F.try_element_at("all2", F.lit(-1)), F.try_element_at("all2", F.lit(-2))
    whole = F.regexp_extract("t", r"\b(\d{2,6})\s*$", 1)
    amount = (F.when(F.size("last_two") >= 2, F.get(pair, F.lit(1))).when(F.size("all2") > 0, flat_number(a_last))
              .when(F.size("all3") > 0, money(F.round(F.try_element_at("all3", F.lit(-1)).cast("decimal(18,3)"), 2)))
              .when(whole != "", money(whole.try_cast("bigint"))))
    df = settle(df, F.struct(amount.alias("amount")), lambda v: v["amount"] > 0)
    prev = flat_number(a_prev)
    sane = (prev > 0) & (prev <= F.greatest(F.col("amount") * 3, F.lit(10000)))
    rate = F.when(F.size("last_two") >= 2, F.get(pair, F.lit(0))) \
        .when((F.size("all2") >= 2) & (a_prev != a_last) & sane, prev).otherwise(money(F.lit(0)))
    name = strip(F.regexp_replace(F.regexp_replace("store", r"\s+", " "), r"^\d+\s+", ""))
    name = F.regexp_replace(name, r"(?i)\bMEDICAL\s*L\b", "MEDICAL")
    found = F.regexp_extract("t", drug, 0)
    df = df.withColumns({
        "rate": rate, "own_store": F.nullif(name, F.lit("")),
        "product": F.when(F.length("product") < 3, found).otherwise(F.col("product")),
    }).where(F.length("product") >= 3)
    pack = F.get(F.filter(F.transform("packs", lambda p: strip(F.regexp_extract(p, X.FLAT_PACK, 0))),
                          lambda p: p != ""), F.lit(0))
    whole_number = lambda c: F.when(F.col(c).rlike(r"^\d{1,18}$"), F.col(c).cast("bigint")).otherwise(F.lit(0))
    # the row is read before it is moved, so its cells and amounts stay behind
    item = df.select("doc_id", "line_no", "t", F.when(F.col("own_store").isNotNull(), F.struct("own_store", "city")).alias("s"), F.col("product").alias("description"),
                     F.coalesce(pack, F.lit("")).alias("packing"), whole_number("q").alias("qty"), whole_number("f").alias("free"), "rate", "amount")
    carried = scan(item, ["doc_id"], fill={"at_store": "s"}, tie="t", keep=["line_no", "description", "packing", "qty", "free", "rate", "amount"])
    out = carried.withColumns({
        "area": F.lit("ALL AREAS"), "store_name": F.coalesce("at_store.own_store", F.lit(UNKNOWN_STORE)),
        "store_location": F.coalesce("at_store.city", F.lit("")), "percent": money(F.lit(0))})
    return as_items(out, "FLAT_PARTY_PRODUCT")


def merge_flat_stores(items: DataFrame) -> DataFrame:
    """Store totals, names compared without case; the first spelling and place by line stand."""
    return items.groupBy("doc_id", F.upper("store_name").alias("store_key")).agg(
        F.min(F.struct("line_no", "store_name", "store_location")).alias("f"),
        F.count("*").alias("n_items"), F.sum("qty").alias("qty"), F.sum("amount").alias("amount")) \
        .select("doc_id", F.col("f.store_name").alias("store_name"), F.col("f.store_location").alias("store_location"),
                "n_items", "qty", "amount")


def flat_grand_total(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Printed grand total of flat reports, else the sum of the rows."""
    t = fix_flat_digits(strip("text"))
    amounts = F.regexp_extract_all(t, F.lit(r"\b\d{1,7}\.\d{2}\b"), F.lit(0))
    printed = lines.where(t.rlike(r"(?i)\b(GRAND\s*TOTAL|END\s*OF\s*REPORT)\b")).groupBy("doc_id").agg(
        F.max_by(flat_number(F.try_element_at(amounts, F.lit(-1))), F.when(F.size(amounts) > 0, F.col("line_no")))
        .alias("printed"))
    total = items.groupBy("doc_id").agg(F.sum("amount").alias("total"))
    return total.join(printed, "doc_id", "left").select(
        "doc_id", money(F.when(F.coalesce("printed", money(F.lit(0))) != 0, F.col("printed"))
                        .otherwise(F.col("total"))).alias("grand_total"))


# The store, product and total patterns of the flat table reader.
READER_STORE = (
    r"(?i)^(?:Dr\.?\s*)?([A-Z][A-Za-z\s]+(?:Store|Medical|Pharmacy|Agency|Trading|Corporation|Distributor|Surgicals|"
    r"Mart|Enterprises|Stores)?)(?:\s*,\s*|\s{2,})([A-Za-z\s]+?(?:Road|Street|Nagar|Colony|Market|Complex|Bazaar|Chowk|"
    r"Circle)?)(?:\s*\(?\s*([A-Za-z\s]+)\)?)?"
)
READER_PRODUCT = (
    r"^(.+?)\s+(\d+[xX]?\d*\.?\d*)\s+(\d+\.?\d*)\s+(\d+\.?\d*)\s+(\d+\.?\d*)(?:\s+(\d+\.?\d*))?(?:\s+(\d+\.?\d*))?"
)
READER_TOTAL = r"(?i)^(?:Total|Grand\s+Total|Net\s+Amount|Amount)\s*:?\s*([\d,]+\.?\d*)"


def flat_table_rows(lines: DataFrame) -> DataFrame:
    """Store rows and product rows below the header of a flat table; products carry the store above them."""
    df = lines.select("doc_id", "line_no", strip("text").alias("t")).where(F.col("t") != "")
    is_header = reduce(lambda a, b: a | b, [F.col("t").rlike(p) for p in L.FLAT_READER_HEADERS])
    area = first_group("t", r"(?i)^Area\s*:\s*(.+)$")
    facts = df.groupBy("doc_id").agg(F.min(F.when(is_header, F.col("line_no"))).alias("opens"))
    body = attach(df, facts, ["doc_id"], "line_no")
    inside = F.col("line_no") > F.col("opens")
    body = body.where(F.coalesce(inside, F.lit(False)) | area.isNotNull()).withColumns({
        "in": F.coalesce(inside, F.lit(False)), "area_mark": F.when(~F.coalesce(inside, F.lit(False)), strip(area))})
    body = body.where(~F.col("in") | ~F.col("t").rlike(READER_TOTAL))
    is_store = F.col("in") & F.col("t").rlike(READER_STORE)
    g = lambda p, i: strip(F.regexp_extract("t", p, i))
    store = F.when(is_store, F.struct(expand_abbreviations(g(READER_STORE, 1)).alias("name"),
                                      g(READER_STORE, 2).alias("place"), F.nullif(g(READER_STORE, 3), F.lit("")).alias("area")))
    rows = scan(body.withColumns({"is_store": is_store, "s": store}), ["doc_id"],
                fill={"store": "s", "area_now": "area_mark"}, tie="t")
    is_product = ~F.col("is_store") & F.col("t").rlike(READER_PRODUCT) & F.col("store").isNotNull()
    rows = rows.where(F.col("in") & (F.col("is_store") | is_product))
    prod = lambda i: F.when(~F.col("is_store"), F.regexp_extract("t", READER_PRODUCT, i)).otherwise("")
    return rows.select(
        "doc_id", "line_no", F.coalesce("store.area", "area_now", F.lit("")).alias("area"),
        F.col("store.name").alias("store_name"), F.col("store.place").alias("store_location"),
        strip(prod(1)).alias("product"), prod(2).alias("qty"), prod(3).alias("free"), prod(4).alias("rate"),
        prod(5).alias("amount"), prod(6).alias("disc_percent"), prod(7).alias("tax_amount"))


def flat_table_summary(rows: DataFrame) -> DataFrame:
    """Rows, distinct stores and areas, amount and quantity per document."""
    qty = F.floor(F.col("qty").try_cast("decimal(18,3)")).cast("bigint")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("total_rows"),
        F.countDistinct(F.nullif("store_name", F.lit(""))).alias("unique_stores"),
        F.coalesce(F.sum(F.col("amount").try_cast("decimal(18,2)")), F.lit(0)).cast("decimal(18,2)").alias("total_amount"),
        F.coalesce(F.sum(qty), F.lit(0)).alias("total_qty"),
        F.countDistinct(F.nullif("area", F.lit(""))).alias("n_areas"))


def flat_table_stores(rows: DataFrame) -> DataFrame:
    """Distinct (store, location) pairs per document, as rows."""
    return rows.where(F.col("store_name") != "").select("doc_id", "store_name", "store_location").distinct()


# ------------------------------------------------------------------ sales book

# fixed value, the pattern of a bill row: date, bill number, party, bill amount, then up to six numbers
BOOK_ROW = r"(?i)^(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\s+([A-Z]{1,3}\d{4,})\s+(.+?)\s+(-?\d[\d,]*\.\d{2})(?:\s+(-?\d[\d,]*\.\d{2}))?(?:\s+(-?\d[\d,]*\.\d{2}))?(?:\s+(-?\d[\d,]*\.\d{2}))?(?:\s+(-?\d[\d,]*\.\d{2}))?(?:\s+(-?\d[\d,]*\.\d{2}))?(?:\s+(-?\d[\d,]*\.\d{2}))?\s*$"
BOOK_FIELDS = ["amount", "taxable", "tax", "sur_tax", "free_amt", "exempted", "round_off"]


def sales_book_items(lines: DataFrame) -> DataFrame:
    """One 'BILL AMOUNT' item per bill row: by the strict pattern, else by tokens and decimals."""
    df = _clean_lines(lines.select("doc_id", "line_no", "text"))
    c = F.upper(F.regexp_replace("t", r"\s+", ""))
    header = (c.contains("PARTYNAME") & c.contains("BILLNO")) | (c.contains("BILLAMT") & c.contains("TAXABLE"))
    opens = df.groupBy("doc_id").agg(F.min(F.when(header, F.col("line_no"))).alias("opens"))
    body = attach(df, opens, ["doc_id"], "line_no").where(F.col("line_no") > F.col("opens"))
    body = settle(body, F.struct(match_groups("t", BOOK_ROW, 10).alias("g"), F.split("t", r"\s+").alias("toks"),
                                 F.col("t").rlike(X.DATE).alias("dated")), lambda r: r["g"].isNotNull() | r["dated"])
    strict = F.col("g").isNotNull()
    decimals = F.filter("toks", lambda w: w.rlike(r"^-?\d[\d,]*\.\d{2}$"))
    body = body.withColumn("dec", F.when(~strict, decimals))

    def party() -> Column:
        at = F.array_position("toks", F.get("dec", F.lit(0))).cast("int")
        loose = F.upper(F.array_join(F.slice("toks", F.lit(3), F.greatest(at - 3, F.lit(0))), " "))
        named = squeeze(F.regexp_replace(F.upper(F.get("g", F.lit(3))), r"[^A-Z0-9&\-\s\.\(\)]", " "))
        return F.when(strict, named).otherwise(F.when(F.size("dec") > 0, loose))

    body = settle(body, F.struct(party().alias("party")),
                  lambda r: F.when(strict, F.length(r["party"]) >= 2).otherwise(r["party"] != ""))

    def amount(i: int) -> Column:
        loose = F.coalesce(F.get("dec", F.lit(i)), F.lit("0"))
        return clean_number(F.when(strict, F.get("g", F.lit(4 + i))).otherwise(loose))

    return as_items(body.withColumns({
        "store_name": F.col("party"), "store_location": F.lit(""), "description": F.lit("BILL AMOUNT"),
        "qty": F.lit(0), "free": F.lit(0), "rate": money(F.lit(0)), "percent": money(F.lit(0)),
        "bill_date": F.get("toks", F.lit(0)), "bill_no": F.coalesce(F.get("toks", F.lit(1)), F.lit("")),
        **{f: amount(i) for i, f in enumerate(BOOK_FIELDS)}}), "SALES_BOOK_REGISTER")


def period_of(items: DataFrame) -> DataFrame:
    """First and last bill date per document by calendar order."""
    d = F.struct(date_key("bill_date").alias("k"), F.col("bill_date").alias("d"))
    return items.where(date_key("bill_date").isNotNull()).groupBy("doc_id").agg(
        F.min(d)["d"].alias("from_date"), F.max(d)["d"].alias("to_date"))


# ------------------------------------------------------------------ paged store invoice

# fixed values: the numbered row of a paged invoice, and product, pack, expiry and batch inside it
PAGED_ROW = (r"(?i)^\s*(\d+)\s+(.*?)\s+(\d+)\s+([A-Z/]+)\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+"
             r"(?:(\d+(?:\.\d+)?)\s+)?(\d+(?:\.\d+)?)%\s+(\d+(?:\.\d+)?)\s+(\d+)\s*$")
PAGED_DETAIL = (r"(?i)^(.+?)\s+(\d+\s*[xX]\s*[A-Z0-9]+|\d+\s*(?:ML|GM|G|MG|TAB|CAP|PCS|M))\s+([A-Za-z]{3}'?\d{2,4})\s+"
                r"(\S+)\s*$")


def _paged_lines(lines: DataFrame) -> DataFrame:
    """Lines with their page section and the store, place and other place that they name. A page also ends where the next 'GST NO :' stands."""
    df = _clean_lines(lines.select("doc_id", "page_no", "line_no", "text"))
    df = scan(df, ["doc_id"], sums={"section": F.col("t").rlike(r"(?i)GST\s+NO\s*:").cast("bigint")}, tie="t", then=lambda rows: rows)
    dated = F.col("t").rlike("(?i)DATE")
    cased = dated & F.col("t").rlike("(?i)NO OF CASES")
    place = F.when(cased, first_group("t", r"(?i)^\s*([A-Za-z][A-Za-z\s.\-]{2,}?)\s+DATE\s*:"))
    after = F.when(dated & ~cased, F.nullif(strip(F.regexp_extract("t", r"(?i)^(.*?)\bDATE\s*:", 1)), F.lit("")))
    store = F.when(F.col("t").rlike(r"(?i)M/S\s"), first_group("t", r"(?i)M/S\s+(.+?)\s+INVOICE\s+NO\.?\s*:"))
    return settle(df, F.struct(strip(store).alias("s"), strip(place).alias("p"), after.alias("a")))


def _paged_sections(lines: DataFrame) -> DataFrame:
    """Lines with their page section and the section's store and place."""
    df = _paged_lines(lines)
    # one printed page: the rows between two page headers
    part = Window.partitionBy("doc_id", "page_no", "section")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).over(part)
    return df.withColumns({"store_text": first("s"), "place": F.coalesce(first("p"), first("a"))}).drop("s", "p", "a")


def paged_invoice_items(lines: DataFrame) -> DataFrame:
    """Item rows of each page's store, plus one row each for the added tax and the round-off of the page."""
    df = _paged_sections(lines).where(F.col("store_text").isNotNull())
    labels = (("tax", r"ADD\s+GST", "SGST CGST ADD GST"), ("off", r"Round\s+off", "Round off"))
    df = settle(df, F.struct(
        F.when(F.col("t").rlike(r"^\d"), match_groups("t", PAGED_ROW, 11)).alias("g"),
        *[F.when(F.col("t").rlike("(?i)" + pat), number_after(pat, "t")).alias(n) for n, pat, _ in labels]),
        lambda r: r["g"].isNotNull() | r["tax"].isNotNull() | r["off"].isNotNull())
    part = Window.partitionBy("doc_id", "page_no", "section")
    # of each label only the first printed value of the page counts
    df = df.withColumns({n + "_at": F.min(F.when(F.col(n).isNotNull(), F.col("line_no"))).over(part) for n, _, _ in labels})
    g = lambda i: F.get("g", F.lit(i))
    detail = F.when(F.col("g").isNotNull(), match_groups(squeeze(g(2)), PAGED_DETAIL, 4))
    df = settle(df, F.struct(detail.alias("d"), squeeze(g(2)).alias("body")))
    d = lambda i: F.coalesce(F.get("d", F.lit(i)), F.lit(""))
    pack = F.regexp_replace(F.upper(d(2)), " ", "")
    name = F.when(F.col("d").isNotNull(), strip(d(1))).otherwise(F.col("body"))
    name = squeeze(F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"\([^)]*$", " "))
    is_row = F.col("g").isNotNull()
    label = F.when(is_row, F.trim(F.concat_ws(" ", name, F.nullif(pack, F.lit("")))))
    amount = F.when(is_row, clean_number(g(10)))
    for n, _, text in labels:
        hit = (F.col(n + "_at") == F.col("line_no")) & (F.col(n) != 0)
        label, amount = label.when(hit, text), amount.when(hit, F.col(n))
    items = df.withColumns({
        "description": label, "amount": amount, "qty": clean_int(F.coalesce(g(5), F.lit("0"))), "free": F.lit(0).cast("bigint"),
        "rate": clean_number(F.coalesce(g(7), F.lit("0"))), "percent": clean_number(F.coalesce(F.nullif(g(8), F.lit("")), F.lit("0"))),
        "mrp": F.when(is_row, clean_number(g(6))), "gst_percent": F.when(is_row, clean_number(g(9))), "hsn": g(11),
        "batch": F.when(is_row, d(4)), "expiry": F.when(is_row, d(3)), "case_qty": F.when(is_row, clean_int(g(3))),
        "case_unit": F.upper(g(4)), "packing": F.when(is_row, pack)})
    items = items.where(F.col("g").isNotNull() | ((F.col("tax_at") == F.col("line_no")) & (F.col("tax") != 0))
                        | ((F.col("off_at") == F.col("line_no")) & (F.col("off") != 0)))
    out = split_store(items, "store_text")
    out = out.withColumn("store_location", F.coalesce(F.nullif("place", F.lit("")), "store_location"))
    return as_items(out.withColumn("area", F.lit("UNKNOWN AREA")), "PAGED_STORE_INVOICE")


def paged_invoice_totals(lines: DataFrame) -> DataFrame:
    """Grand total (sum of subtotals, else of balances), period and header facts per document."""
    per_page = _paged_lines(lines).groupBy("doc_id", "page_no", "section").agg(*[
        F.min_by(number_after(label, "t"), F.when(number_after(label, "t").isNotNull(), F.col("line_no"))).alias(name)
        for label, name in ((r"Sub\s+total", "subtotal"), (r"Total\s+Balance", "balance"))],
        F.min_by(first_group("t", r"(?i)DATE\s*:\s*(\d{1,2}/\d{1,2}/\d{2,4})"),
                 F.when(F.col("t").rlike(r"(?i)DATE\s*:\s*\d{1,2}/\d{1,2}/\d{2,4}"), F.col("line_no"))).alias("date"),
        F.min_by("s", F.when(F.col("s").isNotNull(), F.col("line_no"))).alias("store_text"))
    d = F.when(F.col("date").isNotNull(), F.struct(date_key("date").alias("k"), F.col("date").alias("d")))
    stores = F.col("store_text").isNotNull()
    return per_page.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(stores, F.col("subtotal"))), F.lit(0)).alias("subtotals"),
        F.coalesce(F.sum(F.when(stores, F.col("balance"))), F.lit(0)).alias("balances"),
        F.min(d)["d"].alias("from_date"), F.max(d)["d"].alias("to_date"),
        F.count(F.when(stores, 1)).alias("n_invoices")) \
        .select("doc_id", money(F.when(F.col("subtotals") > 0, F.col("subtotals")).otherwise(F.col("balances")))
                .alias("grand_total"), "from_date", "to_date", "n_invoices")


# ------------------------------------------------------------------ tax invoice

def tax_invoice_rows(lines: DataFrame) -> DataFrame:
    """Numbered rows of the page tables, cut by the nine-field pattern from the joined table text of each document."""
    return joined_rows(table_lines(lines))


def _front(df: DataFrame) -> DataFrame:
    """The words in front of the numbers: expiry, pack, quantity, batch, brand and form, in any order."""
    df = settle(df, F.struct(match_groups("row", f"^{TAX_ROW}$", 9).alias("g")))
    toks = F.split(strip(F.get("g", F.lit(2))), r"\s+")

    def kind(t):
        u = F.upper(t)
        pack = t.rlike(r"\d") & (has_any(u, X.PACK_WORDS) | u.endswith("'S") | (u.endswith("S") & (F.length(t) <= 4)))
        return F.when(t.contains("/") & t.rlike(r"\d\D*\d"), "exp").when(pack, "pack").when(t.rlike(r"^\d+(\.\d+)?$"), "num").otherwise("word")

    def of(k):
        return F.filter("toks", lambda t, i: F.get("kinds", i) == k)

    # each word is judged once
    df = df.withColumn("toks", toks).withColumn("kinds", F.transform("toks", kind))
    filled = F.transform("toks", lambda t, i: (F.get("kinds", i) == "num") & (t.try_cast("double") != 0))
    df = df.withColumns({"qty_at": F.array_position(filled, True).cast("int"),
                         "exps": of("exp"), "pack_tok": F.try_element_at(of("pack"), F.lit(-1))})
    last_num = F.when(F.col("qty_at") > 0, F.col("qty_at")).otherwise(F.size("toks"))
    rest = F.filter("toks", lambda t, i: let(F.get("kinds", i), lambda k: (k == "word") | ((k == "num") & (i >= last_num))))
    date = r"\d{1,2}/\d{2,4}"
    last_exp = F.try_element_at("exps", F.lit(-1))
    prefixes = F.filter(F.transform("exps", lambda t: F.when(t.rlike(date), F.regexp_extract(t, rf"^(.*?)(?={date})", 1))),
                        lambda p: p.isNotNull() & (p != ""))
    df = df.withColumns({
        "rest": rest,
        "expiry": F.coalesce(F.when(last_exp.rlike(date), F.regexp_extract(last_exp, date, 0))
                             .otherwise(F.regexp_replace(last_exp, r"[^0-9/]", "")), F.lit("")),
        "prefix": F.coalesce(F.try_element_at(prefixes, F.lit(-1)), F.lit("")),
        "qty_num": F.get("toks", F.col("qty_at") - 1)})
    tail, head = F.try_element_at("rest", F.lit(-1)), F.get("rest", F.lit(0))
    by_prefix = F.col("prefix").rlike("[A-Za-z]") & F.col("prefix").rlike(r"\d")
    by_tail = ~by_prefix & tail.rlike(r"[\d-]")
    by_head = ~by_prefix & ~tail.rlike(r"[\d-]") & head.rlike(r"[\d-]")
    n = F.size("rest")
    df = df.withColumns({
        "batch": F.coalesce(F.when(by_prefix, F.col("prefix")).when(by_tail, tail).when(by_head, head), F.lit("")),
        "names": F.when(by_tail, F.slice("rest", F.lit(1), n - 1)).when(by_head, F.slice("rest", F.lit(2), n)).otherwise(F.col("rest"))})
    brand = strip(F.regexp_replace(F.array_join("names", " "), r"[\$\\\^]+", ""))
    df = df.withColumn("brand_words", F.filter(F.split(brand, r"\s+"), lambda w: w != ""))
    forms = F.filter(F.array(*[F.lit(w) for w in X.DOSE_WORDS]),
                     lambda d: F.exists("brand_words", lambda w: F.upper(w) == d))
    df = df.withColumn("form", F.coalesce(F.get(forms, F.lit(0)), F.lit("")))
    return df.withColumns({
        "brand": F.array_join(F.filter("brand_words", lambda w: F.upper(w) != F.col("form")), " "),
        "dosage": F.col("form"), "packing": F.coalesce(F.upper("pack_tok"), F.lit("")),
        "qty": F.coalesce(F.col("qty_num").try_cast("decimal(18,3)"), F.lit(0)).cast("bigint")})


def tax_invoice_items(lines: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Items of tax invoices. facts may give doc_id and party (the buyer)."""
    rows = _front(tax_invoice_rows(lines))
    v = lambda i: money(F.replace(F.get("g", F.lit(i)), F.lit(","), F.lit("")).try_cast("decimal(18,2)"))
    out = rows.withColumns({
        "hsn": F.get("g", F.lit(3)), "mrp": v(4), "rate": v(5), "discount_amount": v(6),
        "tax_amount": money(v(7) + v(8)), "amount": v(9), "free": F.lit(0), "percent": money(F.lit(0)),
        "description": F.lit(""), "area": F.lit("UNKNOWN AREA"), "store_location": F.lit("")})
    if facts is None:
        out = out.withColumn("store_name", F.lit(UNKNOWN_STORE))
    else:
        out = attach(out, facts.select("doc_id", F.col("party").alias("store_name"), *[c for c in facts.columns if c == KEY_ROWS]), ["doc_id"], "line_no") \
            .withColumn("store_name", F.coalesce("store_name", F.lit(UNKNOWN_STORE)))
    return as_items(out, "INVOICE")


def tax_invoice_rows_early(lines: DataFrame) -> DataFrame:
    """The simpler reading of tax invoice rows: each field is looked for only at the front of the row."""
    df = lines.select("doc_id", "line_no", strip("text").alias("t"))
    df = df.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("t", F.lit(TAX_ROW), F.lit(0))).alias("i", "row"))
    df = df.withColumn("toks", F.split(strip(F.regexp_extract("row", TAX_ROW, 2)), r"\s+"))

    def take(df: DataFrame, out: str, reach: int, test) -> DataFrame:
        at = F.array_position(F.transform(F.slice("toks", F.lit(1), F.least(F.lit(reach), F.size("toks"))), test), True).cast("int")
        return df.withColumn("at", at).withColumns({
            out: F.when(F.col("at") > 0, F.get("toks", F.col("at") - 1)).otherwise(""),
            "toks": F.when(F.col("at") > 0, F.concat(F.slice("toks", F.lit(1), F.col("at") - 1),
                                                     F.slice("toks", F.col("at") + 1, F.size("toks")))).otherwise(F.col("toks"))})

    df = take(df, "expiry", 4, lambda t: t.contains("/"))
    df = take(df, "qty", 3, lambda t: t.rlike(r"^\d+(\.\d+)?$"))
    df = take(df, "pack", 2, lambda t: t.rlike(r"[A-Za-z']"))
    df = take(df, "batch", 1, lambda t: t.rlike(r"[\d-]") | (F.length(t) > 4))
    v = lambda i: money(F.regexp_replace(F.regexp_extract("row", TAX_ROW, i), ",", "").try_cast("decimal(18,2)"))
    return df.select("doc_id", "line_no", F.array_join("toks", " ").alias("product"), "batch",
                     F.regexp_replace("expiry", r"[^0-9/]", "").alias("expiry"),
                     F.coalesce(F.col("qty").try_cast("decimal(18,3)"), F.lit(0)).cast("decimal(18,3)").alias("qty"), "pack",
                     F.regexp_extract("row", TAX_ROW, 3).alias("hsn"), v(4).alias("mrp"), v(5).alias("ptr"), v(9).alias("amount"))


# ------------------------------------------------------------------ columns found by probing

def mapped_items(lines: DataFrame, maps: DataFrame, report_type: str) -> DataFrame:
    """Items of tab-separated reports by a column map. maps: doc_id, modal (usual number of cells), column_map (field to column).

    A row counts if its number of cells is within one of the usual, its amount is a number and it names a product, store or company.
    """
    df = attach(lines.select("doc_id", "line_no", "text"), maps.select("doc_id", "modal", "column_map"), ["doc_id"], "line_no", how="inner")
    df = df.withColumn("cells", F.split("text", "\t")).where(F.abs(F.size("cells") - F.col("modal")) <= 1)

    def cell(name: str) -> Column:
        return F.coalesce(strip(F.get("cells", F.try_element_at("column_map", F.lit(name)))), F.lit(""))

    df = df.withColumns({f"f_{n}": cell(n) for n in ("amount", "rate", "product_name", "store_name", "area", "qty", "date", "hsn", "packing", "company")})
    named = F.coalesce(*[F.nullif(f"f_{n}", F.lit("")) for n in ("product_name", "store_name", "company")])
    rows = df.where(F.col("f_amount").rlike(r"^-?[\d,]+(\.\d+)?$") & named.isNotNull())
    return as_items(rows.withColumns({
        "description": named, "store_name": F.coalesce(F.nullif("f_store_name", F.lit("")), F.lit(UNKNOWN_STORE)), "store_location": F.lit(""),
        "area": F.coalesce(F.nullif("f_area", F.lit("")), F.lit("UNKNOWN AREA")), "qty": clean_int("f_qty"), "rate": clean_number("f_rate"),
        "amount": clean_number("f_amount"), "bill_date": F.col("f_date"), "hsn": F.col("f_hsn"), "packing": F.col("f_packing")}), report_type)


# ------------------------------------------------------------------ columns inferred from a header

_CLAIMED = "\u0001"


def role_of(name) -> Column:
    """Role of a header word: exact key, else the first key that contains it or is contained, else unknown."""
    pairs = L.role_keys()
    exact = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r")) for k, r in pairs])

    def near(key: Column) -> Column:
        hit = F.get(F.filter(keys, lambda p: (F.length(key) >= 2) & (key.contains(p["k"]) | p["k"].contains(key))), F.lit(0))
        return F.coalesce(F.try_element_at(exact, key), hit["r"], F.lit("unknown"))

    return let(compact(name), near)


def is_header_line(text) -> Column:
    """At least three role words, making up 55 % of the words; no numbers, dates or tax ids."""
    s = strip(text)
    keys = F.array(*[F.lit(k) for k, _ in L.role_keys() if len(k) >= 2])
    hits = let(compact(s), lambda c: F.size(F.filter(keys, lambda k: c.contains(k))))
    barred = (
        (s == "") | F.upper(s).rlike(r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]")
        | s.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}") | s.rlike(r"^[-*=_\s]+$") | s.rlike(r"\d+\.\d{2}"))
    words = F.greatest(F.size(words_of(s)), F.lit(1))
    return F.when(barred, False).otherwise((hits >= 3) & (hits / words >= 0.55))


def header_columns(text) -> Column:
    """Array (col_name, role, x_start, x_end) of a header line: phrases claim their place first, longest first."""
    line = F.col(text) if isinstance(text, str) else text
    phrases = F.array(*[F.lit(p) for p in L.phrases()])
    start = F.struct(line.alias("mask"), F.array().cast("array<struct<x:int,name:string>>").alias("cols"))

    def claim(acc, ph):
        at = F.regexp_instr(line, F.concat(F.lit(r"(?i)\b\Q"), ph, F.lit(r"\E\b")))
        free = (at > 0) & ~F.substring(acc["mask"], at, F.length(ph)).contains(_CLAIMED)
        return F.struct(
            F.when(free, F.overlay(acc["mask"], F.repeat(F.lit(_CLAIMED), F.length(ph)), at)).otherwise(acc["mask"]).alias("mask"),
            F.when(free, F.array_append(acc["cols"], F.struct((at - 1).alias("x"), F.upper(ph).alias("name"))))
            .otherwise(acc["cols"]).alias("cols"))

    def singles(done):
        zero = F.struct(F.lit(1).alias("pos"), done["cols"].alias("cols"))

        def word(acc, w):
            at = F.position(w, line, acc["pos"])
            free = ~F.substring(done["mask"], at, F.length(w)).contains(_CLAIMED)
            return F.struct((at + F.length(w)).alias("pos"), F.when(
                free, F.array_append(acc["cols"], F.struct((at - 1).alias("x"), F.upper(w).alias("name"))))
                .otherwise(acc["cols"]).alias("cols"))

        return F.array_sort(F.aggregate(F.regexp_extract_all(line, F.lit(r"\S+"), F.lit(0)), zero, word)["cols"])

    def placed(cols):
        full = F.transform(cols, lambda c, i: F.struct(
            c["name"].alias("col_name"), role_of(c["name"]).alias("role"), c["x"].alias("x_start"),
            F.coalesce(F.get(cols, i + 1)["x"], F.lit(9999)).alias("x_end")))
        return F.filter(full, lambda c: c["role"] != "serial")

    return let(let(F.aggregate(phrases, start, claim), singles), placed)


def doc_columns(lines: DataFrame) -> DataFrame:
    """First header line per document and the columns it declares."""
    heads = lines.select("doc_id", "line_no", "text").where(is_header_line("text")).groupBy("doc_id").agg(
        F.min(F.struct("line_no", "text")).alias("h"))
    return heads.select("doc_id", F.col("h.line_no").alias("header_line"), F.col("h.text").alias("header_text"),
                        header_columns(F.col("h.text")).alias("cols"))


def inferred_items(lines: DataFrame, agency: DataFrame | None = None) -> DataFrame:
    """Items by the roles of the header's columns.

    With a store column each row names its store; the numbers are peeled from the
    right and dealt to the numeric columns. Without one, text rows are store
    headings and rows are cut at the column positions.
    """
    body = attach(lines.select("doc_id", "line_no", "text"), doc_columns(lines), ["doc_id"], "line_no", how="inner")
    body = body.where((F.col("line_no") > F.col("header_line")) & F.col("text").rlike(r"[^\-\*=_\s]")
                      & ~has_any(F.upper("text"), X.REGISTER_STOP_WORDS))
    roles = F.transform("cols", lambda c: c["role"])
    numeric = F.array(*[F.lit(r) for r in L.NUMERIC_ROLES])
    body = body.withColumns({
        "by_store": F.array_contains(roles, "store"), "by_item": F.array_contains(roles, "item"),
        "num_roles": F.filter(roles, lambda r: F.array_contains(numeric, r)), "data": F.col("text").rlike(r"\d+\.\d{2}")})
    s = strip("text")
    heading = F.when(
        ~F.col("by_store") & F.col("by_item") & ~F.col("data") & (F.length(s) >= 4) & ~s.rlike(r"^\d{1,2}[-/]\d{1,2}")
        & ~is_header_line("text") & s.rlike("[A-Za-z]{3,}") & ~s.rlike(X.DOSAGE_HINT),
        F.nullif(F.upper(strip(F.regexp_replace(s, r"(?i)^M/S\.?\s*", ""))), F.lit("")))
    body = scan(body.withColumn("h", heading), ["doc_id"], fill={"heading": "h"}, tie="text").where(F.col("data"))

    # rows with a store column: numbers from the right, at most as many as numeric columns
    toks = F.split(s, r"\s+")
    fits = F.transform(F.reverse(toks), lambda t: t.rlike(r"^-?[\d,]+(\.\d{1,2})?$"))
    gap = F.array_position(fits, False).cast("int")
    run = F.least(F.when(gap > 0, gap - 1).otherwise(F.size(fits)), F.size("num_roles"))
    body = body.withColumns({"toks": toks, "run": run})
    body = body.withColumns({
        "nums": F.slice("toks", F.size("toks") - F.col("run") + 1, F.col("run")),
        "left": F.array_join(F.slice("toks", F.lit(1), F.size("toks") - F.col("run")), " ")})
    dated = r"(?i)^(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\s+([A-Z]{1,4}\d{3,})\s+(.+)$"
    left = F.col("left")
    is_dated = left.rlike(dated)
    store = F.when(is_dated, F.regexp_extract(left, dated, 3)).when(left.rlike(r"^\d+\s+.+$"),
                                                                    F.regexp_replace(left, r"^\d+\s+", "")).otherwise(left)

    def cell(role: str) -> Column:
        at = F.try_element_at(F.filter("cols", lambda c: c["role"] == role), F.lit(-1))
        return strip(F.substring("text", at["x_start"] + 1, at["x_end"] - at["x_start"]))

    def number(role: str) -> Column:
        at = F.array_position("num_roles", F.lit(role)).cast("int")
        peeled = F.when(at > 0, F.get("nums", at - 1))
        return F.when(F.col("by_store"), F.when(peeled.isNotNull(), clean_number(peeled))) \
            .otherwise(F.when(cell(role) != "", clean_number(cell(role))))

    def text(role: str) -> Column:
        by_store = {"date": F.when(is_dated, F.regexp_extract(left, dated, 1)),
                    "bill_no": F.when(is_dated, F.regexp_extract(left, dated, 2))}.get(role, F.lit(None).cast("string"))
        return F.coalesce(F.when(F.col("by_store"), by_store).otherwise(cell(role)), F.lit(""))

    out = body.withColumns({
        **{r: number(r) for r in ("amount", "rate", "taxable", "tax", "sur_tax", "exempted", "round_off", "discount")},
        "qty_v": number("qty"), "free_v": number("free"), "item": text("item"), "bill_date": text("date"),
        "bill_no": text("bill_no"), "batch": text("batch"), "hsn": text("hsn"), "expiry": text("expiry"),
        "store_text": F.when(F.col("by_store"), squeeze(store)).otherwise(F.col("heading"))})
    out = out.where((F.coalesce("amount", money(F.lit(0))) != 0))
    if agency is not None:
        out = attach(out, agency.select("doc_id", F.col("agency_name").alias("agency")), ["doc_id"], "line_no")
    else:
        out = out.withColumn("agency", F.lit(None).cast("string"))
    out = out.withColumn("store_text", F.coalesce(F.when(
        F.col("by_store"), F.nullif("store_text", F.lit(""))).otherwise(F.coalesce("store_text", "agency", F.lit(UNKNOWN_STORE)))))
    out = split_store(out.where(F.col("store_text").isNotNull()), "store_text")
    return as_items(out.withColumns({
        "store_name": F.upper("store_name"), "area": F.lit("UNKNOWN AREA"),
        "description": F.coalesce(F.nullif("item", F.lit("")), F.lit("BILL AMOUNT")), "qty": F.col("qty_v").cast("bigint"),
        "free": F.col("free_v").cast("bigint"), "free_amt": F.col("free_v"), "percent": F.col("discount")}), "SCHEMA_INFERRED")
