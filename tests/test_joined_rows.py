"""Tax rows over the joined text of a document, against a search of the whole text in Python."""

import random
import re

import pytest

from ledgerlift.operators.extract_tables import tax_invoice_rows
from ledgerlift.operators.joined_rows import TAX_ROW, joined_rows, table_lines

HEAD, TOTAL = "Sn. Qty. Pack Product HSN MRP", "TOTAL 10.00"


def in_tables(lines):
    """Lines in the page tables of one document, page by page."""
    out = []
    for page in sorted({p for p, _, _ in lines}):
        inside = seen = False
        for _, line, text in sorted(x for x in lines if x[0] == page):
            t = text.strip()
            if re.search(r"Sn\.?\s+Qty", t, re.I):
                inside = True
            elif inside and seen and re.search(r"^(?:CLASS|GST\s+\d+\.\d+|TOTAL(?!\s+B/F)|GRAND|SUB\s+TOTAL)", t, re.I):
                inside = False
            elif inside and re.match(r"\d+\.", t):
                seen = True
                out.append((line, t))
    return out


def searched(lines):
    text = re.sub(r"\s+", " ", " ".join(t for _, t in in_tables(lines)))
    return [m.group(0) for m in re.finditer(TAX_ROW, text)]


def rows_of(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["doc_id"], r["line_no"])):
        out.setdefault(r["doc_id"], []).append(r["row"])
    return out


def random_document(rng, size):
    row = "7. 3 10TAB DOLO CAP K1 12/26 30049099 12.50 10.00 0.00 6.00 6.00 112.00".split()
    words = ["12.50", "30049099", "44", "4.", "X7.", "9.Y", "6.00", "5.00CR8.", "1,000.00", "B", "3004", "2.50Z", "7..", "8.1.", "12.x4."]
    lines, page = [(0, 0, HEAD)], 0
    for line in range(1, size):
        pick = rng.random()
        if pick < 0.12:
            page += 1
            text = rng.choice([HEAD, HEAD, "no table"])
        elif pick < 0.18:
            text = rng.choice([TOTAL, "TOTAL B/F 1.00", "GRAND 4", "plain text", ""])
        elif pick < 0.45:
            at = rng.randrange(1, len(row))
            text = " ".join(row[:at])
        elif pick < 0.7:
            text = " ".join([f"{rng.randrange(1, 90)}.50"] + row[-rng.randrange(1, 8):])
        elif pick < 0.85:
            text = "  ".join(["5."] * rng.randrange(2) + ["1." if rng.random() < 0.5 else "2.A"] + rng.choices(words, k=rng.randrange(12)))
        else:
            text = " ".join(row * rng.randrange(1, 4))
        lines.append((page, line, text))
    return lines


@pytest.mark.parametrize("block", [16, 65_536])
def test_rows_of_the_joined_text(spark, block):
    rng = random.Random(block)
    docs = {f"d{i}": random_document(rng, rng.choice([2, 6, 30, 90])) for i in range(120)}
    docs["junk"] = [(0, 0, HEAD)] + [(0, i, f"{i}. nothing") for i in range(1, 60)] + [(1, 60, HEAD), (1, 61, "1.5 A 30049099 1 2 3 4 5 6")]
    docs["halves"] = [(i // 9, i, HEAD if i % 9 == 0 else ("1. NAME 30049099", "12.50 10.00 0 6 6 112")[i % 2]) for i in range(400)]
    docs["single"] = [(0, 0, HEAD)] + [(0, i + 1, t) for i, t in enumerate("1. A 22 1. 2. 3. 4. 5. 6. 7. B 33 1. 2. 3. 4. 5. 6.9x1. C".split())]
    df = spark.createDataFrame([(d, p, n, t) for d, rows in docs.items() for p, n, t in rows], "doc_id string, page_no int, line_no long, text string")
    found = rows_of(joined_rows(table_lines(df), block))
    expected = {d: rows for d, lines in docs.items() if (rows := searched(lines))}
    assert len(expected) > 60 and len(expected["halves"]) > 100
    assert found == expected


def test_no_lines(spark):
    empty = spark.createDataFrame([], "doc_id string, page_no int, line_no long, text string")
    assert tax_invoice_rows(empty).collect() == []
    nulls = spark.createDataFrame([("a", 0, 0, HEAD), ("a", 0, 1, None), (None, 0, 2, "1. A 22 1 2 3 4 5 6")],
                                  "doc_id string, page_no int, line_no long, text string")
    assert tax_invoice_rows(nulls).collect() == []
