"""Text normalisation as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlift import lexicon as X
from ledgerlift.functions.common import col, fold, fold_rare, squeeze, strip, words_of

CONTROL = r"[\x00-\x08\x0b-\x0c\x0e-\x1f]"
# found in every line that one of clean_line's rules changes; no boundaries and no looking back, which cost most
UNCLEAN = r"[A-Za-z]\d+[-/.,]\d|[.,]\d{1,2}[A-Za-z]|[OoTt][Mm][Ee]?[Rr]|==|---|\(cid:\d|" + CONTROL


def heal_delimiters(c) -> Column:
    """Undo CSV quoting printed into a text page; only texts that show it are touched."""
    t = col(c)
    shows = t.contains('",') | t.contains(',"') | t.contains(",,")
    healed = fold(t, [
        (r"\r?\n\s*(?=[,\"])", " "),
        (r"(?<=[,\"])\s*\r?\n", " "),
        (r"\"", " "),
        (r",{2,}", " "),
        (r"(?<!\d),(?!\d)", " "),
    ])
    return F.when(shows, healed).otherwise(t)


def clean_line(c) -> Column:
    """One printed line: glyph codes, control characters, rulers and glued letters and digits."""
    return strip(fold_rare(c, [
        (r"\(cid:\d+\)", " "),
        (CONTROL, ""),
        (r"={2,}|-{3,}", " "),
        (r"([A-Za-z])(\d{1,2}[-/]\d{2,4})\b", "$1 $2"),
        (r"([A-Za-z])(\d+[\.,]\d{1,2})\b", "$1 $2"),
        (r"\b(\d+[\.,]\d{1,2})([A-Za-z])", "$1 $2"),
        (r"(?<=\d\.\d{1,2})[OoQq]\b", "0"),
        (X.CUSTOMER_MISSPELLINGS, "CUSTOMER"),
    ], UNCLEAN))


def compact(c) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(col(c)), r"[^A-Z0-9]+", "")


def spaced(c) -> Column:
    """Upper-case letters and digits, everything else one blank."""
    return strip(F.regexp_replace(F.upper(col(c)), r"[^A-Z0-9]+", " "))


def compact_word(word: str) -> str:
    return "".join(ch for ch in word.upper() if ch.isascii() and ch.isalnum())


def fix_store_spelling(c) -> Column:
    return fold(c, X.STORE_SPELLINGS)


def fix_field_noise(c, field: str) -> Column:
    """The OCR rules of one field; a description that is a known product takes its canonical form."""
    t = fold(c, [(p, r) for p, r, fields in X.FIELD_NOISE if field in fields])
    if field == "Description":
        key = strip(F.regexp_replace(F.upper(t), r"[^A-Z0-9]+", " "))
        known = F.create_map(*[F.lit(v) for kv in X.KNOWN_PRODUCTS.items() for v in kv])
        t = F.coalesce(F.try_element_at(known, key), t)
    return strip(t)


def fix_confused_letters(c) -> Column:
    """Letters misread for digits, word by word; Capitalised words stay."""
    return F.array_join(F.transform(
        words_of(c),
        lambda w: F.when(w.rlike(r"^\p{Lu}\p{Ll}+$"), w)
        .otherwise(F.translate(w, X.CONFUSED_LETTERS, X.CONFUSED_DIGITS)),
    ), " ")


def strict_entity(c, location: bool = False) -> Column:
    """Upper-case entity text without dates and punctuation; names keep '&'."""
    t = F.regexp_replace(F.upper(col(c)), r"\b\d{1,4}[-/\.]\d{1,2}[-/\.]\d{1,4}\b", " ")
    keep = r"[^A-Z0-9\-\s]" if location else r"[^A-Z0-9&\-\s]"
    t = F.regexp_replace(F.regexp_replace(t, keep, " "), r"-{2,}", "-")
    return squeeze(t if location else strip(t, r"\- "))


def vendor(c, rules=None) -> Column:
    """First vendor whose patterns hit, UNKNOWN otherwise."""
    t = col(c)
    branches = [(name, "(?im)" + "|".join(f"(?:{p})" for p in pats)) for name, pats in (rules or X.VENDORS)]
    return reduce(lambda acc, b: acc.when(t.rlike(b[1]), F.lit(b[0])), branches[1:],
                  F.when(t.rlike(branches[0][1]), F.lit(branches[0][0]))).otherwise(F.lit("UNKNOWN"))


def html_to_rows(c) -> Column:
    """HTML to an array of tab text rows: row ends break lines, cell ends become tabs, other tags go."""
    t = fold(c, [(r"(?i)</tr>", "\n"), (r"(?i)</td>", "\t"), (r"<[^>]+>", "")])
    return F.filter(F.transform(F.split(t, "\n"), lambda line: join_cells(F.split(line, "\t"))), lambda r: r != "")


def join_cells(cells: Column, drop_empty: bool = True) -> Column:
    """Cells to tab text; empty cells drop out (columns shift left) unless asked otherwise."""
    clean = F.transform(cells, lambda v: strip(F.regexp_replace(strip(v), r"[\r\n]", " ")))
    return F.array_join(F.filter(clean, lambda v: v != "") if drop_empty else clean, "\t")


def sniff_cells(line, whole=None) -> Column:
    """Cells of a delimited line: tabs when the text has any, commas otherwise."""
    t = col(line)
    return F.when((t if whole is None else col(whole)).contains("\t"), F.split(t, "\t")).otherwise(F.split(t, ","))


def expand_abbreviations(c) -> Column:
    """Store abbreviations written out (case-sensitive)."""
    return fold(squeeze(F.regexp_replace(col(c), r"\s+", " ")), X.STORE_ABBREVIATIONS)


def char_count(c, cls: str) -> Column:
    """How many characters of a class the text holds."""
    return F.length(F.regexp_replace(col(c), rf"[^{cls}]", ""))


def text_confidence(c) -> Column:
    """How table-like a text is, 0 to 1: digits, tabbed lines and filled lines, with two small bonuses."""
    t = F.coalesce(col(c), F.lit(""))
    lines = F.split(t, "\n")
    n_all = F.greatest(F.size(lines), F.lit(1))
    n_filled = F.size(F.filter(lines, lambda x: x.rlike(r"\S")))
    n_tabbed = F.size(F.filter(lines, lambda x: x.rlike(r"\S") & x.contains("\t")))
    size = F.greatest(F.length(t), F.lit(1))
    digits, letters = char_count(t, r"\p{Nd}"), char_count(t, r"\p{L}")
    base = 0.4 * digits / size + 0.3 * n_tabbed / n_filled + 0.3 * n_filled / n_all
    bonus = (F.when(t.rlike(r"\d{2,}[\.,]\d{2}"), 0.05).otherwise(0.0)
             + F.when(letters / size > 0.15, 0.05).otherwise(0.0))
    return (
        F.when(~t.rlike(r"\S"), 0.0)
        .when(digits / size > 0.85, 0.25)
        .when(letters < 5, 0.10)
        .otherwise(F.least(base + bonus, F.lit(1.0)))
    )


def page_quality(c) -> Column:
    """Struct of char_count, num_density, financial_rows, table_rows and weak for one page text."""
    t = F.coalesce(col(c), F.lit(""))
    blank = ~t.rlike(r"\S")
    chars = F.when(blank, 0).otherwise(F.length(t))
    density = F.when(blank, 0.0).otherwise(char_count(t, r"\p{Nd}") / F.length(t))
    money_values = F.when(blank, 0).otherwise(F.regexp_count(t, F.lit(r"\b\d+[\.,]\d{2}\b")))
    table_rows = F.when(blank, 0).otherwise(F.size(F.filter(
        F.split(t, "\n"), lambda x: F.regexp_count(x, F.lit(r"\b\d+(?:\.\d+)?\b")) >= 3)))
    return F.struct(
        chars.cast("bigint").alias("char_count"), density.alias("num_density"),
        money_values.cast("bigint").alias("financial_rows"), table_rows.cast("bigint").alias("table_rows"),
        ((chars < 150) | (density < 0.03)).alias("weak"),
    )


def billable_units(ext, pages, rows) -> Column:
    """Billed pages by file type; 0 means the type is not supported."""
    e = F.lower(col(ext))
    return (
        F.when(e == "pdf", F.greatest(F.lit(1), col(pages)))
        .when(e.isin("jpg", "jpeg", "png", "bmp"), F.lit(3))
        .when(e.isin("csv", "xlsx", "xls"), F.greatest(F.lit(1), F.ceil(col(rows) / 50)))
        .otherwise(F.lit(0)).cast("bigint")
    )
