"""Cleaning of extracted items: stores found inside descriptions, entity and description scrubbing, row flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift import lexicon as X
from ledgerlift.functions.common import let, settle, strip
from ledgerlift.functions.entities import (
    description_parts, scrub_description, scrub_glued, scrub_leading_token, scrub_location, scrub_store_name, store_parts,
)
from ledgerlift.functions.text import fix_field_noise, strict_entity, text_confidence
from ledgerlift.operators.ordered import scan

_TABLE_TITLE = r"(?i)DATE\s+BILLNO\s+ITEM.*?EXP\.?DATE\s*(D\s+)?"
_STORE_IN_ROW = r"^(.+?)\s+D\s+([A-Za-z0-9\-].+)$"


def reparent(items: DataFrame) -> DataFrame:
    """'STORE D item' inside a description opens a new store for this row and the rows behind it in the same store."""
    desc = strip(F.regexp_replace(F.coalesce("description", F.lit("")), _TABLE_TITLE, ""))

    def found(d: Column, cand: Column) -> Column:
        valid = ((F.length(cand) > 8) & (cand.contains(",") | F.upper(cand).rlike(X.TRADE_WORD))
                 & ~cand.rlike(X.DOSAGE_IN_STORE))
        item = F.when(valid, strip(F.regexp_extract(d, _STORE_IN_ROW, 2))).otherwise(d)

        def placed(p: Column) -> Column:
            whole, comma = (p["n"] == "") | (p["n"] == cand), cand.contains(",")
            return F.struct(
                F.when(whole & comma, strip(F.substring_index(cand, ",", 1))).when(whole, cand).otherwise(p["n"]).alias("name"),
                F.when(whole & comma, strip(F.regexp_extract(cand, r"(?s)^[^,]*,(.*)$", 1))).when(whole, "")
                .otherwise(p["l"]).alias("place"))

        return F.struct(F.when(valid, let(store_parts(cand, "n", "l"), placed)).alias("_opened"),
                        strip(F.regexp_replace(item, r"^D\s+", "")).alias("_d"))

    df = settle(items, let(desc, lambda d: let(strip(F.regexp_extract(d, _STORE_IN_ROW, 1)), lambda cand: found(d, cand))))
    # the row's own store is the key: a store found inside it reaches to its last row
    keyed = df.withColumns({"_k1": F.coalesce("store_name", F.lit("")), "_k2": F.coalesce("store_location", F.lit(""))})
    done = scan(keyed, ["doc_id", "_k1", "_k2"],
                fill={"_new": "_opened"}, tie="_d")
    return done.withColumns({
        "store_name": F.coalesce("_new.name", "store_name"),
        "store_location": F.when(F.col("_new").isNotNull(), F.col("_new.place")).otherwise(F.col("store_location")),
        "description": F.col("_d")}).select(*items.columns)


def clean_entities(items: DataFrame) -> DataFrame:
    """Store and location split where missing, scrubbed, spelling and case normalised."""
    has_place = F.coalesce("store_location", F.lit("")) != ""
    given = F.struct(F.coalesce("store_name", F.lit("")).alias("n"), F.coalesce("store_location", F.lit("")).alias("l"))
    parts = F.when(has_place, given).otherwise(store_parts("store_name", "n", "l"))
    return settle(items, let(parts, lambda p: F.struct(
        strict_entity(fix_field_noise(scrub_store_name(p["n"]), "StoreName")).alias("store_name"),
        strict_entity(scrub_location(p["l"]), location=True).alias("store_location")))).select(*items.columns)


def clean_descriptions(items: DataFrame) -> DataFrame:
    """Description scrubbed, then brand, dosage and packaging read from it; known products take their canonical name."""
    d = F.coalesce("description", F.lit(""))
    bill = (F.col("report_type") == "SCHEMA_INFERRED") & (d == "BILL AMOUNT")
    own = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("brand", "dosage", "packing")])
    none = F.struct(*[F.lit("").alias(c) for c in ("brand", "dosage", "packing")])

    def parts(text: Column) -> Column:
        p = F.when(bill, none).when(d == "", own).otherwise(description_parts(text))
        return let(p, lambda q: F.struct(fix_field_noise(text, "Description").alias("description"),
                                         q["brand"].alias("brand"), q["dosage"].alias("dosage"), q["packing"].alias("packing")))

    text = F.when(bill, "PARTY BILL").when(d != "", scrub_glued(scrub_leading_token(scrub_description("description")))).otherwise("")
    return settle(items, let(text, parts)).select(*items.columns)


def row_flags(amount="amount", rate="rate", qty="qty", free="free", description="description") -> Column:
    """Flags of a suspicious row, in fixed order."""
    amt = F.coalesce(F.col(amount), F.lit(0))
    rt, q, f = (F.coalesce(F.col(c), F.lit(0)) for c in (rate, qty, free))
    return F.array_compact(F.array(
        F.when(amt <= 0, "ZERO_AMOUNT"),
        F.when((rt > 0) & (amt > 0) & (rt > amt), "RATE_EXCEEDS_AMOUNT"),
        F.when(F.length(strip(F.coalesce(F.col(description), F.lit("")))) < 4, "SHORT_DESC"),
        F.when(amt > 500000, "UNUSUALLY_LARGE_AMOUNT"),
        F.when((q == 0) & (f == 0) & (amt > 0), "QTY_MISSING")))


def extended_flags(amount="amount", rate="rate", qty="qty", description="description", store="store_name") -> Column:
    """The wider set of flags over raw text values."""
    number = lambda c: F.replace(F.col(c).cast("string"), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    desc = F.coalesce(F.col(description), F.lit(""))
    score = text_confidence(desc)
    amt, q = number(amount), number(qty)
    return F.array_compact(F.array(
        F.when(~desc.rlike(r"\S"), "MISSING_DESCRIPTION"),
        F.when(score < 0.3, "OCR_VERY_LOW_CONFIDENCE").when(score < 0.5, "OCR_LOW_CONFIDENCE"),
        F.when(amt < 0, "NEGATIVE_AMOUNT").when(amt == 0, "ZERO_AMOUNT").when(amt.isNull(), "INVALID_AMOUNT"),
        F.when(q.cast("bigint") <= 0, "ZERO_QTY"),
        F.when(number(rate) > 99999, "UNUSUALLY_HIGH_RATE"),
        F.when((F.col(store) != "") & ~F.col(store).rlike("[A-Za-z]{3,}"), "STORE_NAME_GARBLED")))


def clean_items(items: DataFrame) -> DataFrame:
    """The whole cleaning chain; adds the array column `flags`."""
    return clean_descriptions(clean_entities(reparent(items))).withColumn("flags", row_flags())


def flagged_text(df: DataFrame) -> DataFrame:
    return df.withColumn("qa_flags", F.concat_ws("|", "flags"))


def vendor_hint(lines: DataFrame, rules=None) -> DataFrame:
    """Vendor of each document: the first vendor in registry order that any line shows."""
    order = [name for name, _ in (rules or X.VENDORS)]
    hits = [F.max(F.col("text").rlike("(?im)" + "|".join(f"(?:{p})" for p in pats)).cast("int")).alias(f"v{i}")
            for i, (_, pats) in enumerate(rules or X.VENDORS)]
    per_doc = lines.groupBy("doc_id").agg(*hits)
    names = [F.when(F.col(f"v{i}") == 1, n) for i, n in enumerate(order)]
    return per_doc.select("doc_id", F.coalesce(*names, F.lit("UNKNOWN")).alias("vendor"))


