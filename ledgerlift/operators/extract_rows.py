"""Printed rows to items, for the layouts read line by line.

Shape of every job: lines are annotated with expressions, given a role (row,
text, heading, break), and each run of text lines is joined to the row that ends
it. Context such as the store of a heading is carried with `scan`, so no document
is handled by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift import lexicon as X
from ledgerlift.functions.common import col, has_any, let, may_hold, money, settle, strip
from ledgerlift.functions.entities import split_store, store_parts
from ledgerlift.functions.numbers import clean_int, clean_number, is_numeric
from ledgerlift.functions.rows import (
    join_words, keep_last, largest, nth, overflow_words, peel, period_total, positional_item,
)
from ledgerlift.functions.text import fix_store_spelling
from ledgerlift.operators.headers import header_facts, read_lines
from ledgerlift.operators.ordered import BLOCK_NO, KEY_ROWS, attach, scan
from ledgerlift.schemas import ITEM_FIELDS
from ledgerlift.session import staged

SUMMARY_TYPES = ["SUMMARY", "QUARTERLY_SUMMARY", "MFR_CUSTOMER_SUMMARY"]
AMOUNT_FIRST_TYPES = [*SUMMARY_TYPES, "UNIVERSAL_TWO_COLUMN", "PARTY_SALES_BOOK"]
PAGE_RESET_TYPES = ["INVOICE_SINGLE_PARTY", "SALE_REGISTER_ITEMIZED", "PARTYWISE_SALE_REGISTER", "CUSTOMER_PRODUCT_SALES"]
HEADING_TYPES = ["SALE_REGISTER_ITEMIZED", "INVOICE_SINGLE_PARTY", "PARTY_WISE", "UNIVERSAL_TWO_COLUMN"]
CUMULATIVE = "CUMULATIVE SUMMARY"
FLUSH_CHARS = 80       # waiting text beyond that is a row of its own in summary and two-column layouts
CHUNK_CHARS = 65_536   # characters of waiting text that are folded at once
SHORT = 3              # lines of so many characters never flush
HELD = "\u0001"        # clean lines have no control characters


def as_items(df: DataFrame, report_type: str) -> DataFrame:
    """Project to the working item schema; columns the layout does not have are null."""
    df = df.withColumn("report_type", F.lit(report_type))
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in ITEM_FIELDS])


def doc_facts(lines: DataFrame) -> DataFrame:
    """One row per document: the facts printed above its table. Written, as several steps read them. They know the document's number of
    lines, which must be written, too."""
    sizes = lines.groupBy("doc_id").agg(F.count("*").alias(KEY_ROWS))
    return staged(header_facts(lines, sizes=sizes).select(
        "doc_id", "agency_name", "address", "gstin", "phone", "email", "company", "customer", "party", "last_party", "from_date",
        "to_date", KEY_ROWS), "doc-facts")


def _facts(facts: DataFrame, *cols) -> DataFrame:
    """Columns of the facts that are joined to lines, with the documents' numbers of lines if they are known."""
    return facts.select("doc_id", *cols, *[c for c in facts.columns if c == KEY_ROWS])


def annotate(lines: DataFrame, facts: DataFrame, report_type: str) -> DataFrame:
    """Lines of one layout with cleaned text, words, trailing numbers and line classes."""
    df = read_lines(lines).withColumnRenamed("text", "raw").where((F.col("t") != "") & ~F.col("t").startswith("---"))
    df = attach(df, _facts(facts, "agency_name", "company"), ["doc_id"], "line_no")
    df = df.withColumns({"low": F.lower("t"), "toks": F.split("t", r"\s+"), "dated": F.col("raw").rlike(X.DATE)})
    df = settle(df, peel("toks"))
    n = F.size("nums")
    first = F.get("toks", F.lit(0))
    small = (F.size("toks") >= 2) & (n == 1) & F.get("nums", F.lit(0)).rlike(r"^0*\d{1,3}[\.\-\)]?$")
    bare = (F.size("toks") >= 2) & ((n == 0) | ((n == 1) & ~F.array_join("words", " ").rlike("[A-Za-z]")))
    amount_first = (
        F.lit(report_type in AMOUNT_FIRST_TYPES) & bare & ~small & is_numeric(first)
        & ~is_numeric(F.try_element_at("toks", F.lit(-1)))
        & (first.contains(".") | (F.length(F.regexp_replace(first, "[,-]", "")) > 3)))
    rest = F.slice("toks", F.lit(2), F.size("toks"))
    # few lines need a search for each of these words
    df = df.withColumns({"small": small, "amount_first": amount_first, "told": may_hold("low", [*X.SKIP_HEADERS, *X.BLOCK_WORDS, *X.MODIFIER_WORDS])})
    df = df.withColumns({
        "words": F.when(F.col("amount_first"), rest)
        .when(F.col("small"), F.when(first.rlike(r"^\d+[\.\-\)]?$"), rest).otherwise(F.col("toks")))
        .otherwise(F.col("words")),
        "nums": F.when(F.col("amount_first"), F.array(first))
        .when(F.col("small"), F.array().cast("array<string>")).otherwise(F.col("nums")),
    })
    low = F.col("low")
    agency = F.lower("agency_name")
    period = low.contains("to") & low.rlike(r"\d{2}[-/]\d{2}[-/]\d{2,4}\s*to\s*\d{2}[-/]\d{2}[-/]\d{2,4}")
    page = low.rlike(r"^page\s*[:\-]?\s*\d+") | low.contains("page no")
    columns = low.contains("netamount") | (low.contains("town") & low.contains("name")) | low.contains("net amount")
    skip = ((F.col("told") & has_any("low", X.SKIP_HEADERS)) | ((F.length(agency) > 3) & low.contains(agency))) & ~low.contains("paeries")
    message = low.rlike(r"^\s*(message|msg|sms|mess)\s*:")
    block = (F.col("told") & has_any("low", X.BLOCK_WORDS)) | low.contains("total") & low.rlike(
        r"\btotal\s+[\d.,]+\b|[\d.,]+\s+total\b|^total\s*$|(grand|g\.?)\s*total")
    klass = (
        F.when(period, "skip").when(page, "page").when(columns, "block").when(F.coalesce(skip, F.lit(False)), "skip")
        .when(message, "skip").when(block, "block")
        .when(F.col("told") & has_any("low", X.MODIFIER_WORDS), "modifier").otherwise("row")
    )
    return df.withColumns({
        "class": klass, "n": F.size("nums"), "inline": F.array_join("words", " "),
        # only lines with few numbers or a licence mark can be headings; the others skip the long pattern
        "trade": F.when((F.size("nums") < 3) | has_any("low", ["dl no", "dl.no", "gstin", "retailer"]),
                        F.upper("t").rlike(X.TRADE_WORD)).otherwise(F.lit(False)), "letters": F.col("t").rlike("[A-Za-z]"),
    })


def table_marks(report_type: str) -> Column:
    """True where a table opens, False where it closes: some layouts close at page lines, invoices also at the tax block.

    Carried forward to "strictly before the row", this says whether a row lies in a table.
    """
    opens = F.when(F.col("opens"), True)
    if report_type not in PAGE_RESET_TYPES:
        return opens
    shuts = F.col("class") == "page"
    if report_type == "INVOICE_SINGLE_PARTY":
        shuts = shuts | has_any("low", X.TAX_BLOCK_WORDS)
    return F.when(shuts, False).otherwise(opens)


def heading_text(report_type: str) -> Column:
    """Store text of a heading line, null for other lines: customer, m/s, to, trade words, a leading dash."""
    low, t = F.col("low"), F.col("t")
    tail = r"(?is)\b(add\s*:|invoice|date|dl no|gstin|mob|ph)\b.*$"
    other = has_any("low", ["company", "product", "sales"])
    customer = has_any("low", ["customer :", "customer:", "customer "]) & ~other
    title = has_any("low", ["m/s ", "m/s.", "m/s:"]) & ~other
    to = low.contains("to") & t.rlike(r"(?i)\bto\s*,")
    marked = has_any("low", ["dl no", "dl.no", "gstin", "retailer"])
    plain = F.upper(t).rlike(X.HEADING_SHOP_WORD)
    trade = F.col("trade") & (marked | ((F.col("n") == 0) & plain)) \
        & ~has_any("low", ["paeries", "sale data", "total", "amount", "qty"])
    dash = t.startswith("-") & (F.col("n") == 0) & (F.length(strip(t, r"\- ")) > 2)
    no_brackets = lambda c: F.regexp_replace(c, r"\[.*?\]", "")
    chain = (
        F.when(F.col("small") & ~has_any("low", X.FOOTER_WORDS), F.col("inline"))
        .when(customer, F.regexp_replace(no_brackets(F.regexp_replace(t, r"(?i)^.*?(customer)\s*[:\-]?\s*", "")),
                                         r"(?is)\badd\s*:.*$", ""))
        .when(title, F.regexp_replace(no_brackets(F.regexp_replace(t, r"(?i)^.*?(m/s\.?)\s*[:\-]?\s*", "")), tail, ""))
        .when(to, F.regexp_replace(no_brackets(F.regexp_replace(t, r"(?i)^.*?\bto\s*,\s*(?:m/s\.?\s*)?", "")), tail, ""))
        .when(trade, F.regexp_replace(F.regexp_replace(t, r"(?i)^(?:umber|number)?\s*date\s*[a-z]*\s*", ""), tail, ""))
    )
    if report_type not in [*SUMMARY_TYPES, "SALES_ANALYSIS_SUMMARY", "CUSTOMER_PRODUCT_SALES", "UNIVERSAL_TWO_COLUMN"]:
        chain = chain.when(dash, strip(t, r"\- "))
    return let(strip(chain), lambda h: F.nullif(h, F.lit("")))


ROW = ["t", "raw", "nums", "inline", "n", "dated", "class", "company"]


def islands(df: DataFrame, report_type: str, role: Column, fills: dict | None = None) -> DataFrame:
    """Join each run of 'text' lines to the 'close' line that ends it; one output row per close line.

    Roles: close (emits), text (waits), stop (drops what waits). Text that no close
    line ends is filtered out before anything is gathered. The text is the row's own
    value, so it is as long as the report makes it; layouts with a limit use `flushed_islands`.
    """
    block = [BLOCK_NO] if BLOCK_NO in df.columns else []
    marked = df.withColumn("role", role)
    ends = F.when(F.col("role").isin("close", "stop"), F.struct(F.col("line_no").alias("at"), F.col("role").alias("how")))
    held = F.when(F.col("role") == "text", True).when(F.col("role").isin("close", "stop"), False)

    def wanted(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.coalesce("open", F.lit(False)) & (F.col("end.how") == "close") & F.col("role").isin("close", "text"))
        shared = F.coalesce("held", F.lit(False)) | F.col("before").eqNullSafe(F.col("line_no")) | F.col("after").eqNullSafe(F.col("line_no"))
        return rows.withColumn("alone", (F.col("role") == "close") & ~shared).drop("open", "held", "before", "after")

    # most rows close a run of their own; they are not grouped
    ready = scan(marked, ["doc_id"], next_fill={"end": ends}, fill=fills or {}, fill_before={"open": table_marks(report_type), "held": held},
                 lags={"before": "line_no"}, leads={"after": "line_no"}, tie="raw", blocks=block[0] if block else None,
                 keep=["line_no", "role", *ROW, *block], then=wanted)
    carried = [*ROW, *(fills or {}), *block]
    grouped = ready.where("not alone").groupBy("doc_id", F.col("end.at").alias("line_no")).agg(
        F.max(F.when(F.col("role") == "close", F.struct(*carried))).alias("row"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "text", F.struct("line_no", "t")))).alias("waiting"))
    joined = grouped.select("doc_id", "line_no", F.array_join(F.transform("waiting", lambda x: x["t"]), " ").alias("pending"), "row.*")
    out = ready.where("alone").select("doc_id", "line_no", F.lit("").alias("pending"), *carried).unionByName(joined)
    return out.withColumn("combined", F.trim(F.concat_ws(" ", F.nullif("pending", F.lit("")), "inline")))


def flushed_islands(df: DataFrame, report_type: str, role: Column, fills: dict | None = None, flush: int = FLUSH_CHARS,
                    chunk: int = CHUNK_CHARS) -> DataFrame:
    """As islands, but waiting text of more than `flush` characters comes out as a row of its own (flushed = true) when another
    line of more than three characters follows, whatever ends the run.

    A run of any length is folded in chunks: lines are cut by a running sum of their characters, so a task holds `chunk` characters
    and not the run. What waits at a chunk's start depends on the chunks before it, but only by its length up to the limit; a
    chunk of a longer run gives, for each such length, the length at its end (a map), maps are applied one after the other (one
    small row per chunk), and each chunk is then folded from its true start. The text itself comes from the end of the chunk before.
    """
    extra = list(fills or {})
    block = BLOCK_NO if BLOCK_NO in df.columns else None
    marked = df.withColumn("role", role)
    ends = F.when(F.col("role").isin("close", "stop"), F.struct(F.col("line_no").alias("at"), F.col("role").alias("how")))
    # lines of three characters or less never flush and do not count, so every inner chunk has a flush
    weight = F.when((F.col("role") == "text") & (F.length("t") > SHORT), F.length("t").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    ready = scan(marked, ["doc_id"], next_fill={"end": ends}, fill=fills or {}, sums={"chars": weight},
                 fill_before={"open": table_marks(report_type)}, tie="raw", blocks=block, keep=["line_no", "role", *ROW])
    ready = ready.where(F.coalesce("open", F.lit(False)) & F.col("role").isin("close", "text"))
    # a closing line belongs to the last chunk of its run; a run without an end has no number
    at, number = F.col("end.at").alias("at"), F.floor(F.col("chars") / chunk).alias("chunk")
    line = F.struct("line_no", "t", *extra)
    runs = Window.partitionBy("doc_id", "at")
    chunks = ready.groupBy("doc_id", at, number).agg(
        F.max(F.when(F.col("role") == "close", F.struct(*ROW, *extra))).alias("row"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "text", line))).alias("lines")) \
        .withColumn("chunks", F.count("*").over(runs))
    full = flush + 1

    def longer(p, n):
        return F.when((p >= full) & (n > SHORT), F.least(n, F.lit(full))).otherwise(F.least(p + F.when(p > 0, 1).otherwise(0) + n, F.lit(full)))

    states = F.transform(F.sequence(F.lit(0), F.lit(full)), lambda s: F.aggregate("lines", s, lambda p, x: longer(p, F.length(x["t"]))))
    order = chunks.where("chunks > 1").select("doc_id", "at", F.struct("chunk", states.alias("to")).alias("m")) \
        .groupBy("doc_id", "at").agg(F.array_sort(F.collect_list("m")).alias("maps"))
    begin = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<chunk:bigint,s:int>>").alias("starts"))
    starts = order.select("doc_id", "at", F.explode(F.aggregate("maps", begin, lambda acc, m: F.struct(
        F.get(m["to"], acc["s"]).alias("s"), F.array_append(acc["starts"], F.struct(m["chunk"].alias("chunk"), acc["s"].alias("s"))).alias("starts")))["starts"])
        .alias("x")).select("doc_id", F.col("at").alias("s_at"), F.col("x.chunk").alias("s_chunk"), F.col("x.s").alias("start"))
    joined = chunks.join(starts.withColumnRenamed("doc_id", "s_doc"), (F.col("doc_id") == F.col("s_doc")) & F.col("at").eqNullSafe(F.col("s_at"))
                         & (F.col("chunk") == F.col("s_chunk")), "left")
    # what waited at the start is held open by as many marks
    held = F.repeat(F.lit(HELD), F.coalesce("start", F.lit(0)))
    none = F.lit(None).cast(ready.select(line.alias("l")).schema["l"].dataType)

    def step(acc, x):
        flushes = (F.length(acc["p"]) > flush) & (F.length(x["t"]) > SHORT)
        new = flushes | (acc["p"] == "")
        return F.struct(F.when(new, x["t"]).otherwise(F.concat_ws(" ", acc["p"], x["t"])).alias("p"), x.alias("last"),
                        F.when(flushes, F.array_append(acc["out"], F.struct(acc["last"].alias("line"), acc["p"].alias("p")))).otherwise(acc["out"]).alias("out"))

    kind = f"array<struct<line:{none_type(ready, line)},p:string>>"
    folded = joined.withColumn("f", F.aggregate("lines", F.struct(held.alias("p"), none.alias("last"), F.array().cast(kind).alias("out")), step))
    in_run = runs.orderBy("chunk")
    before = F.struct(F.lag("f.p").over(in_run).alias("p"), F.lag("f.last").over(in_run).alias("last"))
    folded = folded.select("doc_id", "at", "row", "f", before.alias("b"))
    whole = lambda p: F.when(p.startswith(HELD), F.concat(F.col("b.p"), F.ltrim(p, F.lit(HELD)))).otherwise(p)
    texts = F.transform("f.out", lambda x: F.struct(F.coalesce(x["line"], F.col("b.last")).alias("line"), whole(x["p"]).alias("p"), F.lit(True).alias("flushed")))
    close = F.when(F.col("row").isNotNull(), F.array(F.struct(none.alias("line"), whole(F.col("f.p")).alias("p"), F.lit(False).alias("flushed"))))
    each = folded.select("doc_id", "at", "row", F.explode(F.concat(texts, F.coalesce(close, F.array().cast(close_type(none_type(ready, line)))))).alias("x"))
    got = lambda c, otherwise: F.when(F.col("x.flushed"), otherwise).otherwise(F.col(f"row.{c}")).alias(c)
    blank = {"t": F.col("x.p"), "raw": F.col("x.p"), "inline": F.lit(""), "n": F.lit(0), "dated": F.lit(False), "class": F.lit("row")}
    out = each.select("doc_id", F.coalesce("x.line.line_no", "at").alias("line_no"), F.col("x.p").alias("pending"), F.col("x.flushed").alias("flushed"),
                      *[got(c, blank.get(c, F.lit(None))) for c in ROW], *[got(c, F.col(f"x.line.{c}")) for c in extra])
    return out.withColumn("combined", F.trim(F.concat_ws(" ", F.nullif("pending", F.lit("")), "inline")))


def none_type(df: DataFrame, value: Column) -> str:
    return df.select(value.alias("v")).schema["v"].dataType.simpleString()


def close_type(line: str) -> str:
    return f"array<struct<line:{line},p:string,flushed:boolean>>"


def _modifier_amount() -> Column:
    last = clean_number(nth("nums", -1))
    negative = has_any(F.lower("combined"), ["discount", "disc", "less"]) & (last > 0)
    return money(F.when(negative, -last).otherwise(last))


def _plain(c) -> Column:
    """Description without a leading serial and trailing numbers."""
    return strip(F.regexp_replace(strip(F.regexp_replace(c, r"^\d+[\.\-]?\s*", "")), r"[\d.,\-\s]+$", ""))


def _with_modifiers(rows: DataFrame, items: dict) -> DataFrame:
    """Item columns for plain rows; adjustment rows carry only a description and a signed amount."""
    mod = F.col("class") == "modifier"
    blank = dict(qty=F.lit(0).cast("bigint"), free=F.lit(0).cast("bigint"), rate=money(F.lit(0)), percent=money(F.lit(0)),
                 amount=_modifier_amount(), description=_plain(F.col("combined")))
    return rows.withColumns({k: F.when(mod, blank[k]).otherwise(v) if k in blank else v for k, v in items.items()})


def _zero(**known) -> dict:
    base = dict(qty=F.lit(0).cast("bigint"), free=F.lit(0).cast("bigint"), rate=money(F.lit(0)), percent=money(F.lit(0)))
    return {**base, **known}


def _is_stop() -> Column:
    return F.col("class").isin("skip", "page", "block")


def _is_modifier() -> Column:
    return (F.col("class") == "modifier") & (F.col("n") >= 1)


# ------------------------------------------------------------------ summary layouts

def summary_items(lines: DataFrame, facts: DataFrame, report_type: str = "SUMMARY", flush: int = FLUSH_CHARS) -> DataFrame:
    """One amount per store: last number, period total or largest number, by layout. Small-serial text rows are areas.

    Waiting text of more than `flush` characters is a store without an amount."""
    ann = annotate(lines, facts, report_type)
    heading = F.col("small") & (F.col("class") == "row")
    role = F.when(_is_stop() | heading, "stop").when(_is_modifier() | (F.col("n") >= 1), "close").otherwise("text")
    area = F.when(heading & (strip("inline") != ""), strip("inline"))
    rows = flushed_islands(ann, report_type, role, {"area": area}, flush)
    name = strip(F.regexp_replace(strip("combined"), r"[\d.,\-\s]+$", ""))
    if report_type == "MFR_CUSTOMER_SUMMARY":
        amount = largest("nums")
        name = let(strip(F.regexp_replace(name, r"(?i)^[A-Z]+\s+Default\s*", "")), _without_maker)
        name = F.regexp_replace(strip(name), r"^\d+[\.\-]?\s+", "")
    else:
        amount = period_total("nums") if report_type == "QUARTERLY_SUMMARY" else clean_number(nth("nums", -1))
        name = strip(F.regexp_replace(name, r"^\d+[\.\-:]?\s*", ""))
        name = F.regexp_replace(name, r":(?=[A-Za-z])", " - ")
    rows = rows.withColumns({"store_text": fix_store_spelling(F.when(F.col("flushed"), strip("pending")).otherwise(name)),
                             "amount0": F.when(F.col("flushed"), money(F.lit(0))).otherwise(amount)})
    rows = split_store(rows, "store_text", keep=lambda s: (F.col("class") == "modifier") | F.col("flushed") | s["store_name"].rlike("[A-Za-z]"))
    return as_items(_with_modifiers(rows, _zero(description=F.lit(CUMULATIVE), amount=F.col("amount0"))), report_type)


def _without_maker(name: Column) -> Column:
    """A leading first word of the header's company goes."""
    maker = F.get(F.split("company", r"\s+"), F.lit(0))
    rest = F.substring(name, F.length(maker) + 1, F.length(name))
    starts = (F.length(maker) > 2) & F.lower(name).startswith(F.lower(maker)) & ~rest.rlike(r"^\w")
    return F.when(starts, strip(rest)).otherwise(name)


def sales_analysis_items(lines: DataFrame, facts: DataFrame, report_type: str = "SALES_ANALYSIS_SUMMARY") -> DataFrame:
    """Rows numbered 'n.' hold a store and its total."""
    ann = annotate(lines, facts, report_type)
    numbered = F.get("toks", F.lit(0)).rlike(r"^\d+\.") & (F.col("n") >= 1)
    role = F.when(_is_stop(), "stop").when(_is_modifier() | numbered, "close").otherwise("text")
    rows = islands(ann, report_type, role)
    rows = split_store(rows.withColumn("store_text", fix_store_spelling(strip(
        F.regexp_replace(strip("combined"), r"^\d+\.", "")))), "store_text",
        keep=lambda s: (F.col("class") == "modifier") | (s["store_name"] != ""))
    amount = clean_number(nth("nums", -1))
    return as_items(_with_modifiers(rows, _zero(description=F.lit(CUMULATIVE), amount=amount)), report_type)


def sales_book_entries(lines: DataFrame, facts: DataFrame, report_type: str = "PARTY_SALES_BOOK") -> DataFrame:
    """The amount stands before the name and the name runs on over the next lines, up to the next entry or a total."""
    ann = annotate(lines, facts, report_type)
    first = F.get("toks", F.lit(0))
    priced = is_numeric(first) & ~F.regexp_replace("t", " ", "").rlike(r"^\d+$")
    named = (F.col("n") == 0) & F.col("trade") & ~priced
    row = F.col("class") == "row"
    mark = F.when(row & (priced | named), F.col("line_no")).when(_is_stop(), F.lit(-1).cast("bigint"))
    open_rows = scan(ann, ["doc_id"], fill={"entry": mark}, fill_before={"open": table_marks(report_type)}, tie="raw", blocks=BLOCK_NO) \
        .where(F.coalesce("open", F.lit(False)) & (F.col("entry") >= 0) & ~_is_stop())
    is_entry = F.col("line_no") == F.col("entry")
    part = F.when(is_entry & priced, F.array_join(F.slice("toks", F.lit(2), F.size("toks")), " ")).otherwise(F.col("t"))
    grouped = open_rows.groupBy("doc_id", F.col("entry").alias("line_no")).agg(
        F.max(F.when(is_entry, F.when(priced, clean_number(first)).otherwise(money(F.lit(0))))).alias("amount"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", part.alias("x")))),
                                 lambda r: r["x"]), " ").alias("name"))
    rows = split_store(grouped.withColumn("name", fix_store_spelling(strip("name"))), "name", keep=lambda s: (
        s["store_name"].rlike("[A-Za-z]") & ~has_any(F.lower(s["store_name"]), X.BLOCK_WORDS)))
    return as_items(rows.withColumns(_zero(description=F.lit(CUMULATIVE))), report_type)


def two_column_items(lines: DataFrame, facts: DataFrame, report_type: str = "UNIVERSAL_TWO_COLUMN",
                     flush: int = FLUSH_CHARS) -> DataFrame:
    """Description and last number; the store is the heading, else the customer of the header. Waiting text of more than `flush`
    characters is an item without an amount."""
    ann = annotate(lines, facts, report_type)
    heading = F.when(F.col("class") == "row", heading_text(report_type))
    role = F.when(_is_stop() | heading.isNotNull(), "stop").when(F.col("n") >= 1, "close").otherwise("text")
    rows = flushed_islands(ann.withColumn("heading", heading), report_type, role, {"store_text": "heading"}, flush)
    plain = F.when(F.col("flushed"), strip("pending")).otherwise(_plain(F.col("combined")))
    rows = split_store(rows.withColumn("d", plain), "d", "item_text", "item_place", keep=lambda s: (
        (F.col("class") == "modifier") | F.col("flushed") | (s["item_text"].rlike("[A-Za-z]") & (F.length(s["item_text"]) >= 3))))
    rows = attach(rows, _facts(facts, "customer"), ["doc_id"], "line_no")
    rows = split_store(rows.withColumn("store_text", F.coalesce(
        "store_text", F.nullif("customer", F.lit("")), F.lit("UNKNOWN CUSTOMER"))), "store_text")
    amount = F.when(F.col("flushed"), money(F.lit(0))).otherwise(clean_number(nth("nums", -1)))
    return as_items(_with_modifiers(rows, _zero(description=F.col("item_text"), amount=amount)), report_type)


# ------------------------------------------------------------------ registers and invoices

def _pre_table_store(facts: DataFrame) -> DataFrame:
    """Store fallback per document: the party behind M/S in the header, customer, the text's last M/S, then the agency when it is no
    agency by name."""
    agency = strip(F.regexp_replace(F.regexp_replace("agency_name", r"[^A-Za-z0-9&\-\s]", " "), r"\s{2,}", " "))
    usable = ~has_any(F.upper("agency_name"), ["AGENCY", "DISTRIBUTOR"]) & (F.length(agency) > 3)
    return _facts(facts, store_parts(F.coalesce(
        F.when(F.length("party") > 2, F.col("party")), F.nullif("customer", F.lit("")),
        F.col("last_party"), F.when(usable, agency), F.lit("UNKNOWN STORE"))).alias("fallback"))


def _stores_from_headings(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Name and location of the carried store; rows before any heading take the document's fallback store."""
    known = attach(rows, _pre_table_store(facts), ["doc_id"], "line_no").withColumn("store", F.coalesce("store", "fallback", store_parts(F.lit(""))))
    return known.select(*[c for c in known.columns if c not in ("store", "fallback", "store_name", "store_location")], "store.*")


def _split(text) -> Column:
    """Store of a heading, null for other lines: split where the heading stands, not in each row that it is carried to."""
    return F.when(col(text).isNotNull(), store_parts(text))


def register_items(lines: DataFrame, facts: DataFrame, report_type: str = "SALE_REGISTER_ITEMIZED",
                   expect_headings: bool = False) -> DataFrame:
    """Dated rows of an itemised or party-wise register; surplus leading numbers belong to the description.

    With expect_headings, the first text line after a total or page line is a store
    heading even without a trade word (one more pass over the lines).
    """
    ann = annotate(lines, facts, report_type)
    if report_type == "PARTYWISE_SALE_REGISTER":
        shop = (~F.col("dated") & (F.col("n") == 0) & F.col("letters") & F.col("t").contains(",")
                & (F.length("t") > 5) & F.col("trade"))
        heading = F.when((F.col("class") == "row") & shop, F.col("t"))
    elif expect_headings:
        ann = scan(ann.where(F.col("class") != "skip"), ["doc_id"], lags={"prev_class": F.when(F.col("opens"), "block").otherwise(F.col("class"))}, tie="raw", blocks=BLOCK_NO)
        expected = (F.coalesce("prev_class", F.lit("block")).isin("block", "page")
                    & (F.col("n") == 0) & F.col("letters") & ~F.col("dated"))
        heading = F.when(F.col("class") == "row", F.coalesce(heading_text(report_type), F.when(expected, F.col("t"))))
    else:
        heading = F.when(F.col("class") == "row", heading_text(report_type))
    item = F.col("dated") & (F.col("n") >= 1)
    role = (F.when(_is_stop() | F.col("heading").isNotNull(), "stop").when(_is_modifier() | item, "close")
            .when(F.col("n") >= 1, "stop").otherwise("text"))
    rows = islands(ann.withColumn("heading", heading), report_type, role, {"store": _split("heading")})
    surplus = join_words("inline", F.array_join(overflow_words("nums", 5), " "))
    if report_type == "PARTYWISE_SALE_REGISTER":
        desc = F.regexp_replace(strip(surplus), r"^\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s+\S+\s+", "")
    else:
        desc = join_words(F.nullif("pending", F.lit("")), surplus)
    rows = rows.withColumn("i", positional_item(keep_last("nums", 5), F.lit(True)))
    rows = _stores_from_headings(rows, facts)
    items = {k: F.col(f"i.{k}") for k in ("qty", "free", "rate", "amount", "percent")}
    return as_items(_with_modifiers(rows, {**items, "description": desc}), report_type)


def single_party_items(lines: DataFrame, facts: DataFrame, report_type: str = "INVOICE_SINGLE_PARTY") -> DataFrame:
    """Invoice of one party: rows ending in a decimal amount; quantity is the first small whole number in front."""
    ann = annotate(lines, facts, report_type)
    last = nth("nums", -1)
    item = (F.col("n") >= 2) & (last.rlike(r"\d+\.\d{2}$") | last.isin("0", "0.0", "0.00"))
    heading = F.when(F.col("class") == "row", heading_text(report_type))
    role = (F.when(_is_stop() | F.col("heading").isNotNull() | has_any("low", X.TAX_BLOCK_WORDS), "stop")
            .when(_is_modifier() | item, "close").otherwise("text"))
    rows = islands(ann.withColumn("heading", heading), report_type, role, {"store": _split("heading")})
    desc = join_words(F.nullif("pending", F.lit("")), "inline", F.array_join(overflow_words("nums", 5), " "))
    desc = strip(F.regexp_replace(desc, r"\s+\d{4,8}\s+\d+\.\d{1,2}$", ""))
    rows = rows.withColumns({"d": desc, "kept": keep_last("nums", 5)})
    front = strip(F.regexp_replace(strip(F.regexp_replace("d", r"[\d.,\-\s]+$", "")), r"^\s*\d{1,3}[\.\)\-]+\s+", ""))
    lead = F.get(F.filter(F.slice(F.split(front, r"\s+"), 1, 3), lambda w: w.rlike(r"^\d{1,5}$")), F.lit(0))
    rows = rows.withColumn("lead", lead)
    qty = F.when(F.col("lead").isNotNull() & (F.col("lead").cast("bigint") != 0), F.col("lead").cast("bigint")) \
        .otherwise(clean_int(nth("kept", 0)))
    # description words keep their order when the quantity leaves
    ws = F.split("d", r"\s+")
    pos = F.array_position(ws, F.col("lead"))
    trimmed = F.when(F.col("lead").isNotNull() & (pos > 0), F.array_join(
        F.concat(F.slice(ws, F.lit(1), pos.cast("int") - 1), F.slice(ws, pos.cast("int") + 1, F.size(ws))), " ")) \
        .otherwise(F.col("d"))
    rows = _stores_from_headings(rows.withColumn("trimmed", trimmed), facts)
    return as_items(_with_modifiers(rows, _zero(description=F.col("trimmed"), qty=qty, amount=clean_number(last))),
                    report_type)


# ------------------------------------------------------------------ product layouts

def _carry_stores(rows: DataFrame, is_store: Column, store_text: Column, facts: DataFrame) -> DataFrame:
    """Store rows hand their name to the rows behind them and leave."""
    marked = rows.withColumn("is_store", is_store)
    carried = scan(marked, ["doc_id"], fill={"store": F.when(F.col("is_store"), store_parts(store_text))}, blocks=BLOCK_NO,
                   keep=["line_no", "is_store", "class", "nums", "combined", "d", "kept"])
    return _stores_from_headings(carried.where(~F.col("is_store")), facts)


def customer_product_items(lines: DataFrame, facts: DataFrame, report_type: str = "CUSTOMER_PRODUCT_SALES") -> DataFrame:
    """Rows of three numbers or more are products; trade-word lines before them name the store."""
    ann = annotate(lines, facts, report_type)
    store = (F.col("class") == "row") & (F.col("n") < 3) & F.col("trade") & ~F.col("t").rlike(r"^[\d\s.,\-]+$")
    role = (F.when(_is_stop(), "stop").when(_is_modifier() | (F.col("n") >= 3) | store, "close").otherwise("text"))
    rows = islands(ann, report_type, role)
    desc = join_words(F.nullif("pending", F.lit("")), "inline", F.array_join(overflow_words("nums", 6), " "))
    desc = strip(F.regexp_replace(F.regexp_replace(desc, r"INV\s+\d+\s+\d{2}[-/]\d{2}[-/]\d{2,4}", ""), r"\b\d{5,}\b", ""))
    is_store = (F.col("class") == "row") & (F.col("n") < 3)
    rows = rows.withColumns({"d": desc, "kept": keep_last("nums", 6)})
    rows = _carry_stores(rows, is_store, join_words(F.nullif("pending", F.lit("")), "t"), facts)
    rows = rows.where((F.col("class") == "modifier") | F.col("d").rlike("[A-Za-z]"))
    last, prev = clean_number(nth("kept", -1)), clean_number(nth("kept", -2))
    amount = last if report_type == "CUSTOMER_PRODUCT_SALES" else F.when(F.abs(prev) > F.abs(last), prev).otherwise(last)
    return as_items(_with_modifiers(rows, _zero(description=F.col("d"), qty=clean_int(nth("kept", 0)),
                                                free=clean_int(nth("kept", 1)), amount=amount)), report_type)


def party_product_items(lines: DataFrame, facts: DataFrame, report_type: str = "PARTY_PRODUCT_WISE") -> DataFrame:
    """Four numbers, or two ending in a decimal, make an item; trade words or a place without pack sizes make a store."""
    ann = annotate(lines, facts, report_type)
    last = nth("nums", -1)
    numbered = (F.col("n") >= 4) | ((F.col("n") >= 2) & (last.rlike(r"\d+\.\d{2}$") | last.isin("0", "0.0", "0.00")))
    empty = (F.col("n") <= 1) & ~F.col("letters")
    shop_line = (F.col("class") == "row") & (F.col("n") == 0) & F.upper("t").rlike(X.HEADING_SHOP_WORD)
    role = (F.when(_is_stop(), "stop").when(_is_modifier() | numbered | shop_line, "close")
            .when(empty, "skip").otherwise("text"))
    rows = islands(ann, report_type, role)
    text = join_words(F.nullif("pending", F.lit("")), F.when(F.col("n") == 0, F.col("t")).otherwise(F.col("inline")),
                      F.array_join(overflow_words("nums", 5), " "))
    rows = rows.withColumns({"d": text, "kept": keep_last("nums", 5)})
    packed = F.col("d").rlike(X.PACK_INFO)
    is_store = (F.col("class") == "row") & ~packed & (
        F.upper("d").rlike(X.TRADE_WORD) | F.col("d").rlike(r",\s*[A-Za-z\s\.]+$"))
    rows = _carry_stores(rows, is_store, F.col("d"), facts)
    five, three = F.size("kept") == 5, F.size("kept") >= 3
    qty = clean_int(F.when(five, nth("kept", 1)).otherwise(nth("kept", 0)))
    free = clean_int(F.when(five, nth("kept", 2)).when(three, nth("kept", 1)).otherwise(F.lit("0")))
    amount = clean_number(F.when(five, nth("kept", 3)).when(three, nth("kept", 2)).otherwise(nth("kept", -1)))
    desc = F.when(five, F.concat_ws(" ", "d", nth("kept", 0))).otherwise(F.col("d"))
    rows = rows.where((F.col("class") == "modifier") | (F.size("kept") >= 2))
    return as_items(_with_modifiers(rows, _zero(description=desc, qty=qty, free=free, amount=amount)), report_type)


def wise_items(lines: DataFrame, facts: DataFrame, report_type: str = "ITEM_WISE") -> DataFrame:
    """Item-wise: an item heading, then '-STORE' rows. Party-wise: a store heading, then item rows."""
    ann = annotate(lines, facts, report_type)
    item_wise = report_type == "ITEM_WISE"
    heading = F.lit(None).cast("string") if item_wise else F.when(
        (F.col("class") == "row") & (F.col("n") == 0), heading_text(report_type))
    role = (F.when(_is_stop() | F.col("heading").isNotNull(), "stop").when(_is_modifier() | (F.col("n") >= 1), "close")
            .otherwise("text"))
    rows = islands(ann.withColumn("heading", heading), report_type, role, {"store_head": _split("heading")})
    rows = rows.withColumns({"kept": keep_last("nums", 5),
                             "row_text": join_words("inline", F.array_join(overflow_words("nums", 5), " "))})
    dash = F.col("row_text").startswith("-") & (F.length(strip("row_text", r"\- ")) > 1)
    by_trade = rf"(?i)^-([A-Za-z0-9\(\)&\.\s\-]+?(?:{X.TRADE_ROOTS})[^\s]*)\s*(.*)"
    by_code = r"^-([A-Za-z0-9\(\)&\.\s\-]+?-[A-Za-z0-9]+)\s*(.*)"
    pattern_store = F.when(F.col("row_text").rlike(by_trade), F.regexp_extract("row_text", by_trade, 1)) \
        .otherwise(F.regexp_extract("row_text", by_code, 1))
    pattern_item = F.when(F.col("row_text").rlike(by_trade), F.regexp_extract("row_text", by_trade, 2)) \
        .otherwise(F.regexp_extract("row_text", by_code, 2))
    both = F.length(strip(pattern_item)) > 2
    rows = rows.withColumns({
        "dash": dash & (F.col("class") == "row"),
        "dash_text": F.when(both, strip(pattern_store)).otherwise(strip("row_text", r"\- ")),
        "dash_item": F.when(both, strip(pattern_item)),
        "head_text": strip(join_words(F.nullif("pending", F.lit("")), "row_text")),
    })
    rows = rows.withColumn("dash_store", F.when(F.col("dash"), store_parts("dash_text")))
    kept = ["line_no", "class", "nums", "dated", "combined", "pending", "kept", "dash", "dash_store", "dash_item", "head_text", "store_head"]
    if item_wise:
        # the item heading is a numbered row without a dash
        carried = scan(rows, ["doc_id"], fill={"item": F.when(~F.col("dash") & (F.col("class") == "row"), F.col("head_text"))},
                       blocks=BLOCK_NO, keep=kept)
        carried = carried.where(F.col("dash") | (F.col("class") == "modifier"))
        desc = F.coalesce("dash_item", F.nullif("item", F.lit("")), F.nullif("pending", F.lit("")), F.lit(CUMULATIVE))
        carried = carried.withColumn("store", F.col("dash_store"))
    else:
        carried = scan(rows, ["doc_id"], fill={"dash_carried": F.when(F.col("dash"), F.struct("line_no", "dash_store"))},
                       blocks=BLOCK_NO, keep=kept)
        carried = carried.withColumn("store", F.coalesce("dash_carried.dash_store", "store_head"))
        desc = F.when(F.col("dash"), F.coalesce("dash_item", F.nullif("pending", F.lit("")), F.lit(CUMULATIVE))) \
            .otherwise(F.col("head_text"))
    out = carried.withColumns({"d": desc, "i": positional_item("kept", F.col("dated"))})
    out = _stores_from_headings(out, facts).where((F.col("class") == "modifier") | F.col("d").rlike("[A-Za-z]"))
    items = {k: F.col(f"i.{k}") for k in ("qty", "free", "rate", "amount", "percent")}
    return as_items(_with_modifiers(out, {**items, "description": F.col("d")}), report_type)


# report type -> job(lines, facts, report_type)
JOBS = {
    "SUMMARY": summary_items, "QUARTERLY_SUMMARY": summary_items, "MFR_CUSTOMER_SUMMARY": summary_items,
    "SALES_ANALYSIS_SUMMARY": sales_analysis_items, "PARTY_SALES_BOOK": sales_book_entries,
    "UNIVERSAL_TWO_COLUMN": two_column_items, "SALE_REGISTER_ITEMIZED": register_items,
    "PARTYWISE_SALE_REGISTER": register_items, "INVOICE_SINGLE_PARTY": single_party_items,
    "CUSTOMER_PRODUCT_SALES": customer_product_items, "CUSTOMER_WISE_PRODUCT_WISE": customer_product_items,
    "PARTY_PRODUCT_WISE": party_product_items, "ITEM_WISE": wise_items, "PARTY_WISE": wise_items,
}
