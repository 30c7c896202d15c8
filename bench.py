"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names instead of the headline set
"""

from __future__ import annotations

import json
import os
import time

from ledgerlift.catalog import QUERIES
from ledgerlift.session import local_session

HEADLINE = [
    "usage_kpis", "usage_by_customer", "log_page", "credit_admission", "statement_verdicts", "statement_items", "flat_items",
    "sales_book_items", "paged_invoice_items", "tax_invoice_items", "right_peel_summary", "itemised_register", "inferred_schema_items",
    "page_quality", "document_numbers", "layout_features", "fingerprint_route", "grand_total_reconcile", "reparent_stores", "row_flags",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    QUERIES["usage_status_counts"](spark, folder).collect()  # session warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
