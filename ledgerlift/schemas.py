"""Output schemas. Column order and names of the three tables are fixed values."""

from pyspark.sql import types as T

_MONEY = T.DecimalType(18, 2)

LINES = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("text", T.StringType()),
])

# The 32 columns of the flat fact table, in order.
FACT = T.StructType([
    T.StructField("Agency Name", T.StringType()),
    T.StructField("Agency Address", T.StringType()),
    T.StructField("GSTIN", T.StringType()),
    T.StructField("From Date", T.StringType()),
    T.StructField("To Date", T.StringType()),
    T.StructField("Company", T.StringType()),
    T.StructField("Area", T.StringType()),
    T.StructField("Store Name", T.StringType()),
    T.StructField("Store Location", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Brand Name", T.StringType()),
    T.StructField("Dosage", T.StringType()),
    T.StructField("Packaging", T.StringType()),
    T.StructField("Qty", T.LongType()),
    T.StructField("Free", T.LongType()),
    T.StructField("Rate", _MONEY),
    T.StructField("Amount", _MONEY),
    T.StructField("Percent", _MONEY),
    T.StructField("Tax Amount", _MONEY),
    T.StructField("Discount Amount", _MONEY),
    T.StructField("Doc Type", T.StringType()),
    T.StructField("Bill Date", T.StringType()),
    T.StructField("Bill No", T.StringType()),
    T.StructField("Taxable", _MONEY),
    T.StructField("Tax", _MONEY),
    T.StructField("Sur Tax", _MONEY),
    T.StructField("Free Amt", _MONEY),
    T.StructField("Exempted", _MONEY),
    T.StructField("Round Off", _MONEY),
    T.StructField("Source File", T.StringType()),
    T.StructField("Layout", T.StringType()),
    T.StructField("QA Flags", T.StringType()),
])

# The 13 columns of the QA table.
QA = T.StructType([
    T.StructField("Source File", T.StringType()),
    T.StructField("Agency Name", T.StringType()),
    T.StructField("Layout", T.StringType()),
    T.StructField("Total Rows", T.LongType()),
    T.StructField("Clean Rows", T.LongType()),
    T.StructField("Flagged Rows", T.LongType()),
    T.StructField("Total Amount", _MONEY),
    T.StructField("Grand Total", _MONEY),
    T.StructField("Coverage %", T.DoubleType()),
    T.StructField("QA Pass", T.StringType()),
    T.StructField("QA Summary", T.StringType()),
    T.StructField("AI Format Tier", T.IntegerType()),
    T.StructField("AI Format Confidence", T.DoubleType()),
])

# The 6 columns of the run summary.
SUMMARY = T.StructType([
    T.StructField("File Name", T.StringType()),
    T.StructField("Status", T.StringType()),
    T.StructField("Actual Amount", _MONEY),
    T.StructField("CSV Amount", _MONEY),
    T.StructField("Missing Gap Amount", _MONEY),
    T.StructField("Remarks", T.StringType()),
])

# The working form of an extracted row, before cleaning. Missing = null.
ITEM_FIELDS = [
    ("doc_id", "string"), ("line_no", "bigint"), ("report_type", "string"),
    ("area", "string"), ("store_name", "string"), ("store_location", "string"),
    ("description", "string"), ("brand", "string"), ("dosage", "string"), ("packing", "string"),
    ("qty", "bigint"), ("free", "bigint"), ("rate", "decimal(18,2)"), ("amount", "decimal(18,2)"),
    ("percent", "decimal(18,2)"), ("tax_amount", "decimal(18,2)"), ("discount_amount", "decimal(18,2)"),
    ("bill_date", "string"), ("bill_no", "string"),
    ("taxable", "decimal(18,2)"), ("tax", "decimal(18,2)"), ("sur_tax", "decimal(18,2)"),
    ("free_amt", "decimal(18,2)"), ("exempted", "decimal(18,2)"), ("round_off", "decimal(18,2)"),
    ("mrp", "decimal(18,2)"), ("gst_percent", "decimal(18,2)"),
    ("hsn", "string"), ("batch", "string"), ("expiry", "string"),
    ("case_qty", "bigint"), ("case_unit", "string"),
]
