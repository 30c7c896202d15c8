"""Totals: printed grand totals, reconciliation, output rows, document status and quality roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift import lexicon as X
from ledgerlift.functions.common import has_any, money, strip
from ledgerlift.functions.numbers import clean_number, is_numeric
from ledgerlift.operators.ordered import KEY_ROWS, attach, scan
from ledgerlift.schemas import FACT

# Money limits of the checks.
TOTAL_ROW_TOLERANCE, ADJUST_LIMIT, MATCH_TOLERANCE, COVERAGE_NEEDED, SANE_TOTAL = 2, 5, 1, 85.0, 999_999


def _line_numbers(text="text") -> Column:
    toks = F.split(strip(text), r"\s+")
    return F.transform(F.filter(toks, is_numeric), clean_number)


def expected_total(lines: DataFrame) -> DataFrame:
    """Largest number on any total line, per document."""
    return lines.where(F.col("text").rlike(X.TOTAL_LINE)).groupBy("doc_id").agg(
        F.max(F.array_max(_line_numbers())).alias("expected_total"))


def document_total(lines: DataFrame) -> DataFrame:
    """Largest sane number on any labelled total line that is no page line; 0 when there is none."""
    low = F.lower("text")
    total = has_any(low, X.TOTAL_LABELS) | low.rlike(r"^\s*[\d.,]+\s+total\s*$|^\s*total\s+[\d.,]+\s*$")
    value = F.array_max(F.filter(_line_numbers(), lambda v: v <= SANE_TOTAL))
    return lines.groupBy("doc_id").agg(F.coalesce(F.max(F.when(
        total & ~low.contains("page"), value)), money(F.lit(0))).alias("grand_total"))


def nearby_total(lines: DataFrame) -> DataFrame:
    """Grand total from total lines and their neighbours: decimals from 100 up to a million first, else whole numbers."""
    flagged = lines.withColumn("is_total", has_any(F.lower("text"), X.TOTAL_LABELS))
    near = scan(flagged, ["doc_id"], lags={"up": "is_total"}, leads={"down": "is_total"}, tie="text")
    near = near.where(F.col("is_total") | F.coalesce("up", F.lit(False)) | F.coalesce("down", F.lit(False)))
    sane = lambda v: (v >= 100) & (v < 1_000_000)
    decimals = F.transform(F.regexp_extract_all(F.replace("text", F.lit(","), F.lit("")), F.lit(r"\d+\.\d{1,2}"), F.lit(0)),
                           lambda s: s.try_cast("decimal(18,2)"))
    wholes = F.transform(F.regexp_extract_all("text", F.lit(r"\b\d{4,9}\b"), F.lit(0)), lambda s: s.try_cast("decimal(18,2)"))
    best = near.groupBy("doc_id").agg(F.max(F.array_max(F.filter(decimals, sane))).alias("d"),
                                      F.max(F.array_max(F.filter(wholes, sane))).alias("w"))
    return best.select("doc_id", F.coalesce("d", "w", money(F.lit(0))).alias("grand_total"))


def within(extracted, printed, tolerance: float = MATCH_TOLERANCE) -> Column:
    """Totals agree; a document without a printed total passes."""
    return (F.col(printed) <= 0) | (F.abs(F.col(extracted) - F.col(printed)) < tolerance)


def output_rows(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows that go to the fact table, reconciled with the printed total.

    items: cleaned rows, line_no unique in a document. docs: doc_id, grand_total,
    report_type, from_date, to_date. All decisions are per-document aggregates
    joined back, never a walk over one document's rows.
    """
    d, s = F.lower(F.coalesce("description", F.lit(""))), F.lower(F.coalesce("store_name", F.lit("")))
    items = items.withColumn("_hint", has_any(d, X.INVOICE_HINT_WORDS) | has_any(s, X.INVOICE_HINT_WORDS))
    per_doc = items.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"), F.max(F.struct("line_no", "amount")).alias("last"),
        F.max("_hint").alias("hint"))
    per_doc = per_doc.join(docs.select("doc_id", "grand_total", F.col("report_type").alias("mode"), "from_date", "to_date"),
                           "doc_id", "left")
    last = F.col("last.amount")
    drops = (F.col("n") > 1) & (F.abs(last - (F.col("total") - last)) <= TOTAL_ROW_TOLERANCE)
    same_day = (F.coalesce("from_date", F.lit("")) != "") & (F.col("from_date") == F.col("to_date"))
    kept_sum = F.when(drops, F.col("total") - last).otherwise(F.col("total"))
    gap = F.coalesce("grand_total", money(F.lit(0))) - kept_sum
    per_doc = per_doc.select(
        "doc_id", F.col("n").alias(KEY_ROWS), F.when(drops, F.col("last.line_no")).alias("total_line"),
        (F.col("n") - drops.cast("int")).alias("n_valid"), F.coalesce("grand_total", money(F.lit(0))).alias("doc_total"),
        F.when((F.coalesce(F.col("mode"), F.lit("")) == "PAGED_STORE_INVOICE") | F.coalesce(same_day, F.lit(False))
               | F.col("hint"), "INVOICE").otherwise("STATEMENT").alias("doc_type"),
        F.when((F.col("grand_total") > 0) & (F.abs(gap) > 0) & (F.abs(gap) <= ADJUST_LIMIT), gap).alias("gap"))
    rows = attach(items.drop("_hint"), per_doc, ["doc_id"], "line_no") \
        .where(F.col("total_line").isNull() | (F.col("line_no") != F.col("total_line")))
    top = rows.where(F.col("gap").isNotNull()).groupBy("doc_id").agg(
        F.max(F.struct("amount", (-F.col("line_no")).alias("p"))).alias("t")).select("doc_id", (-F.col("t.p")).alias("line_no"),
                                                                                     F.lit(True).alias("adjusted"))
    rows = rows.join(top, ["doc_id", "line_no"], "left")
    fix = F.coalesce("adjusted", F.lit(False))
    rows = rows.withColumns({
        "amount": money(F.when(fix, F.col("amount") + F.col("gap")).otherwise(F.col("amount"))),
        "description": F.when(fix, F.concat("description", F.lit(" [ROUNDING ADJ]"))).otherwise(F.col("description"))})
    d = F.lower(F.coalesce("description", F.lit("")))
    adjustment = has_any(F.concat_ws(" ", d, s), X.ADJUSTMENT_WORDS)
    repeats = (F.col("amount") > 0) & (F.col("amount") == F.col("doc_total")) & (F.col("n_valid") > 1)
    rows = rows.where(~((F.col("doc_type") == "INVOICE") & adjustment) & ~has_any(d, X.TOTAL_DESCRIPTIONS) & ~repeats)
    tax = has_any(d, X.TAX_WORDS) | has_any(s, X.TAX_WORDS)
    disc = has_any(d, X.DISCOUNT_WORDS) | has_any(s, X.DISCOUNT_WORDS)
    return rows.withColumns({
        "tax_amount": money(F.when(tax, F.col("amount")).otherwise(F.lit(0))),
        "discount_amount": money(F.when(~tax & disc, F.col("amount")).otherwise(F.lit(0)))}) \
        .drop("total_line", "n_valid", "gap", "adjusted")


def fact_table(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The 32-column fact table. docs: doc_id, agency_name, address, gstin, company, from_date, to_date, format_id, source_file."""
    r = attach(rows, docs.select("doc_id", "agency_name", "address", "gstin", "company", "from_date", "to_date",
                                 "format_id", "source_file"), ["doc_id"], "line_no")
    source = {
        "Agency Name": "agency_name", "Agency Address": "address", "GSTIN": "gstin", "From Date": "from_date",
        "To Date": "to_date", "Company": "company", "Area": "area", "Store Name": "store_name",
        "Store Location": "store_location", "Description": "description", "Brand Name": "brand", "Dosage": "dosage",
        "Packaging": "packing", "Qty": "qty", "Free": "free", "Rate": "rate", "Amount": "amount", "Percent": "percent",
        "Tax Amount": "tax_amount", "Discount Amount": "discount_amount", "Doc Type": "doc_type", "Bill Date": "bill_date",
        "Bill No": "bill_no", "Taxable": "taxable", "Tax": "tax", "Sur Tax": "sur_tax", "Free Amt": "free_amt",
        "Exempted": "exempted", "Round Off": "round_off", "Source File": "source_file", "Layout": "format_id"}
    defaults = {"Area": "UNKNOWN AREA", "Store Name": "UNKNOWN STORE", "Layout": "UNKNOWN_FORMAT"}
    cols = []
    for f in FACT.fields:
        c = F.concat_ws("|", "flags") if f.name == "QA Flags" else F.col(source[f.name]).cast(f.dataType)
        if f.dataType.typeName() == "string":
            c = F.coalesce(c, F.lit(defaults.get(f.name, "")))
        elif f.name not in ("Taxable", "Tax", "Sur Tax", "Free Amt", "Exempted", "Round Off"):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        cols.append(c.alias(f.name))
    return r.select(*cols)


def written_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.sum("amount").alias("csv_amount"), F.count("*").alias("n_rows"))


def item_counts(items: DataFrame) -> DataFrame:
    """Areas, stores and items per document."""
    return items.groupBy("doc_id").agg(
        F.countDistinct(F.coalesce("area", F.lit("UNKNOWN AREA"))).alias("n_areas"),
        F.countDistinct(F.coalesce("store_name", F.lit("")), F.coalesce("store_location", F.lit(""))).alias("n_stores"),
        F.count("*").alias("n_items"))


def run_summary(docs: DataFrame, written: DataFrame, expected: DataFrame) -> DataFrame:
    """Verdict per document.

    docs: doc_id, source_file, extension, n_chars, error (null when read). A file
    that could not be read or processed keeps its own status.
    """
    j = docs.join(written, "doc_id", "left").join(expected, "doc_id", "left")
    got = F.coalesce("csv_amount", money(F.lit(0)))
    want = F.coalesce("expected_total", money(F.lit(0)))
    n = F.coalesce("n_rows", F.lit(0))
    gap = F.abs(got - want)
    unsupported = (F.col("extension") == "pdf") & (n == 0) & (F.col("n_chars") > 150)
    status = (
        F.when(F.col("error") == "missing", "File Not Found").when(F.col("error") == "unreadable", "Extraction Error")
        .when(F.col("error").isNotNull(), "Crash").when(unsupported, "UNSUPPORTED_FORMAT")
        .when(want <= 0, "Grand Total Not Found").when(gap < MATCH_TOLERANCE, "Perfect Match")
        .otherwise("Mismatch Detected"))
    st = F.col("Status")
    checked = st.isin("Perfect Match", "Mismatch Detected")
    return j.withColumns({"Status": status, "_gap": money(gap)}).select(
        "doc_id", F.col("source_file").alias("File Name"), "Status", money(want).alias("Actual Amount"),
        money(got).alias("CSV Amount"), F.when(checked, F.col("_gap")).otherwise(money(F.lit(0))).alias("Missing Gap Amount"),
        F.when(st == "Perfect Match", "Values matching")
        .when(st == "Mismatch Detected", F.concat(F.lit("Check final amount / Gap found: "), F.col("_gap").cast("string")))
        .when(st == "Grand Total Not Found", "Unable to auto-verify Grand Total")
        .when(st == "UNSUPPORTED_FORMAT", "Native Text Extracted but Regex Failed")
        .when(st == "File Not Found", "File does not exist").otherwise(F.coalesce("error", F.lit(""))).alias("Remarks"))


def quality(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows, flagged rows, coverage of the printed total and the verdict, per document. items carry `flags`."""
    per_doc = items.groupBy("doc_id").agg(
        F.count("*").alias("total_rows"), F.count(F.when(F.size("flags") > 0, 1)).alias("flagged_rows"),
        F.sum("amount").alias("total_amount"))
    j = docs.select("doc_id", "grand_total").join(per_doc, "doc_id", "left").fillna(0, ["total_rows", "flagged_rows"])
    total = F.coalesce("total_amount", money(F.lit(0)))
    want = F.coalesce("grand_total", money(F.lit(0)))
    coverage = F.when(want > 0, total.cast("double") / want.cast("double") * 100).otherwise(F.lit(100.0))
    j = j.withColumn("cov", coverage)
    return j.select(
        "doc_id", "total_rows", "flagged_rows", (F.col("total_rows") - F.col("flagged_rows")).alias("clean_rows"),
        money(total).alias("total_amount"), money(want).alias("grand_total"), F.round("cov", 2).alias("coverage_pct"),
        ((F.col("flagged_rows") == 0) & (F.col("cov") >= COVERAGE_NEEDED)).alias("qa_pass"),
        F.format_string("%d rows | %d flagged | coverage %.1f%%", "total_rows", "flagged_rows", "cov").alias("qa_summary"))


def qa_table(qual: DataFrame, docs: DataFrame) -> DataFrame:
    """The 13-column QA table. docs: doc_id, source_file, agency_name, format_id, tier, confidence."""
    j = qual.join(docs.select("doc_id", "source_file", "agency_name", "format_id", "tier", "confidence"), "doc_id")
    return j.select(
        F.col("source_file").alias("Source File"), F.coalesce("agency_name", F.lit("")).alias("Agency Name"),
        F.col("format_id").alias("Layout"), F.col("total_rows").alias("Total Rows"),
        F.col("clean_rows").alias("Clean Rows"), F.col("flagged_rows").alias("Flagged Rows"),
        F.col("total_amount").alias("Total Amount"), F.col("grand_total").alias("Grand Total"),
        F.col("coverage_pct").alias("Coverage %"), F.when(F.col("qa_pass"), "YES").otherwise("NO").alias("QA Pass"),
        F.col("qa_summary").alias("QA Summary"), F.col("tier").alias("AI Format Tier"),
        F.col("confidence").alias("AI Format Confidence"))


def flag_rollup(items: DataFrame) -> DataFrame:
    """Rows and amount per layout and flag, with sub-totals (null = all)."""
    one = items.select("report_type", F.explode(F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit("CLEAN"))))
                       .alias("flag"), "amount")
    return one.rollup("report_type", "flag").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount"))
