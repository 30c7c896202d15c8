"""Growing tables are joined without broadcasts, and order lines once for several printers."""

import re

import pytest

from ledgerlift.catalog import detection
from ledgerlift.sources import render

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("frame", [render.sales, render.order_totals, render.quarterly_report])
def test_growing_tables_are_not_broadcast(spark, frame):
    assert plan(frame(spark, DATA)).count("BroadcastHashJoin") <= 1  # nations


def test_order_lines_are_dealt_out_twice(spark):
    """Once by part and once by order; the window over an order needs no exchange of its own."""
    moved = [x for x in re.findall(r"Exchange hashpartitioning\((\w+)", plan(render.sales(spark, DATA)))]
    assert sorted(moved) == ["c_custkey", "l_orderkey", "l_partkey", "o_custkey", "o_orderkey", "p_partkey"]


def test_printers_share_one_join_of_order_lines(spark):
    lines = plan(detection._corpus(spark, DATA))
    assert "lineitem.parquet" not in lines


def test_pages_are_printed_from_one_join(spark):
    assert "lineitem.parquet" not in plan(render.paged_invoices(spark, DATA))
