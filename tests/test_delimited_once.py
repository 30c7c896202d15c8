"""The text of a delimited line is cut once, not once per field and again in filters."""

from ledgerlift.operators import extract_tables as T


def test_cells_of_a_delimited_line_are_cut_once(spark):
    lines = spark.createDataFrame([("1", 1, "S\tP\t1*2\t3\t0\t1.00\t5.00\t0\t0"), ("1", 2, "  "), ("1", 3, "GRAND TOTAL\t5.00")], "doc_id string, line_no bigint, text string")
    formats = spark.createDataFrame([("1", "BUSY_PARTY_PRODUCT_WISE")], "doc_id string, format_id string")
    items = T.delimited_items(lines, formats, party_as_store=True)
    assert items._jdf.queryExecution().executedPlan().toString().count("split(") <= 2  # in the projection, and its name in the generator
    assert [(r["store_name"], r["description"], r["qty"], float(r["amount"])) for r in items.collect()] == [("S", "P", 3, 5.0)]
