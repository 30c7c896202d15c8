"""A sample of the registered queries against DuckDB; the driver checks all of them."""

import duckdb
import pytest

from ledgerlift.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["usage_kpis", "log_page", "credit_admission", "statement_verdicts", "flat_items", "sales_book_items", "paged_invoice_items",
          "tax_invoice_items", "quarterly_totals", "column_position_items", "page_quality", "document_numbers", "store_location_split",
          "layout_features", "template_score", "grand_total_reconcile", "row_flags", "live_kpis", "live_admission", "received_summary"]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def _norm(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 90
