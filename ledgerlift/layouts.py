"""Layout registries: fingerprints, delimited schemas, probe templates, column roles.

All tables below are fixed values. `all` words must stand in one header line,
`any`/`exclude` words anywhere in the header; every word is compared upper-case
with everything but letters and digits removed.
"""

# --- fixed values: keyword registry (case-sensitive, whole text) -----------------------------
KEYWORD_LAYOUTS = [
    dict(format_id="STANDARD_GST_INVOICE", report_type="INVOICE", min_matches=5,
         keywords=["Sn.", "Pack", "Qty.", "Product", "Batch", "Exp.", "HSN"]),
]

# --- fixed values: header fingerprints, in priority order -------------------------------------
FINGERPRINTS = [
    dict(format_id="FORMAT_26_PAGED_STORE_INVOICE", report_type="PAGED_STORE_INVOICE",
         all=["SL", "ITEM DESCRIPTION", "PACK", "EXPIRY", "BATCH", "C/B", "QTY+FR", "MRP", "RATE", "GST", "AMOUNT",
              "HSNCODE"], any=["INVOICENO", "M/S"]),
    dict(format_id="FORMAT_14", report_type="SALE_REGISTER_ITEMIZED",
         all=["DATE", "BILLNO", "ITEM", "BATCH NO", "QTY", "FREE", "SALE PR", "AMOUNT", "EXP.DATE"]),
    dict(format_id="FORMAT_08", report_type="UNIVERSAL_TWO_COLUMN",
         all=["BILL NO", "STORE NAME", "AMOUNT", "DISCOUNT", "NET AMT", "TAX PAYABLE", "DR/CR"]),
    dict(format_id="FORMAT_10", report_type="SUMMARY",
         all=["INVOICE NO", "INVOICE DATE", "STORENAME", "PLACE", "VALUE", "TOTAL"]),
    dict(format_id="FORMAT_09", report_type="SUMMARY",
         all=["QTY", "UNITS", "NETT SALE AMT", "AVG PRICE", "NO OF VCH"]),
    dict(format_id="FORMAT_17", report_type="QUARTERLY_SUMMARY", all=["SL NO", "STORE NAME", "AREA"],
         special="quarter_or_months"),
    dict(format_id="FORMAT_18", report_type="SUMMARY",
         all=["CUSTOMER NAME", "NET AMOUNT", "GOODS VALUE", "GST AMOUNT", "PRODDISC"]),
    dict(format_id="FORMAT_15_OR_16", report_type="MFR_CUSTOMER_SUMMARY",
         all=["GROUP/CUSTOMER", "QTY", "FREE", "GROSS VAL", "NET VALUE"]),
    dict(format_id="FORMAT_25", report_type="SUMMARY", all=["CUSTOMER", "STATION", "MOBILENO", "SALES VALUE"]),
    dict(format_id="FORMAT_23_OR_24", report_type="ITEM_WISE",
         all=["PRODUCT CODE", "PRODUCT NAME", "PACKING", "QTY", "VALUE"]),
    dict(format_id="FORMAT_22", report_type="SUMMARY",
         all=["SL NO", "STORE NAME", "STORE LOCATION", "SALE-NET", "SAL-AMT"]),
    dict(format_id="FORMAT_12_OR_13", report_type="SUMMARY",
         all=["STORENAME", "STORE LOCATION", "SALES", "RETURN", "AMOUNT"]),
    dict(format_id="FORMAT_19_OR_20", report_type="PARTY_PRODUCT_WISE",
         all=["STORE NAME", "STORE LOCATION", "QTY", "FREE", "AMOUNT", "FREE AMOUNT", "PACKS", "BRANDDETAILS"]),
    dict(format_id="FORMAT_21", report_type="QUARTERLY_SUMMARY", all=[], special="store_total_month"),
    dict(format_id="FORMAT_07", report_type="QUARTERLY_SUMMARY", all=[], special="store_month_total"),
    dict(format_id="FORMAT_03", report_type="PARTY_PRODUCT_WISE",
         all=["SERIAL NO", "PRODUCT CODE", "BRAND NAME", "QTY", "PRICE", "FREE UNITS", "AMOUNT", "DISCOUNT"]),
    dict(format_id="FORMAT_01_OR_02", report_type="PARTY_PRODUCT_WISE",
         all=["STORE NAME", "STORE LOCATION", "BRAND NAME", "QTY", "PRICE", "FREE UNITS", "AMOUNT", "DISCOUNT"],
         special="agency_hint"),
    dict(format_id="FORMAT_04", report_type="PARTY_PRODUCT_WISE",
         all=["STORE NAME", "QTY", "PRICE", "FREE UNITS", "AMOUNT", "DISCOUNT", "BRANDNAME"]),
    dict(format_id="FORMAT_06", report_type="PARTY_SALES_BOOK", all=[], special="amount_before_store"),
    dict(format_id="FORMAT_05", report_type="SUMMARY", all=["STORE NAME", "AMOUNT"],
         exclude=["QTY", "PRICE", "FREE UNITS"]),
    dict(format_id="FORMAT_11", report_type="SUMMARY", all=["CODE", "STORENAME", "PLACE", "TOTAL"]),
    dict(format_id="FORMAT_27_SALES_BOOK", report_type="SALES_BOOK_REGISTER",
         all=["DATE", "BILL NO", "PARTY NAME", "BILL AMT"], special="sales_book"),
    dict(format_id="FORMAT_28_PARTYWISE", report_type="PARTYWISE_SALE_REGISTER",
         all=["DATE", "BILL REF", "PRODUCT", "PACK", "QTY FREE", "AMOUNT"]),
]
# second look with weaker conditions, only for headers no fingerprint claimed
STRUCTURAL = [
    dict(format_id="FORMAT_19_OR_20", report_type="PARTY_PRODUCT_WISE",
         all=["STORE NAME", "STORE LOCATION", "QTY", "FREE", "AMOUNT", "FREE AMOUNT", "PACKS"], any=["BRANDDETAILS"]),
    dict(format_id="FORMAT_04", report_type="PARTY_PRODUCT_WISE",
         all=["STORE NAME", "QTY", "PRICE", "FREE UNITS", "AMOUNT", "DISCOUNT"], any=["BRANDNAME"]),
    dict(format_id="FORMAT_05", report_type="SUMMARY", all=["STORE NAME", "AMOUNT"],
         exclude_together=["QTY", "PRICE", "FREE UNITS"]),
]
AGENCY_HINT = r"(?i)\b(AGENCY|AGENCIES|DISTRIBUTORS?|TRADERS?|PHARMA|MEDICALS?|GSTIN|DL\s*NO)\b"

# --- fixed values: header wording cascade (first hit wins; default two-column) ----------------
# keys: any / all / none = words in the spaced header; compact = any word in the compact header
LEGACY_CASCADE = [
    ("INVOICE_SINGLE_PARTY", dict(any=["GST INVOICE", "TAX INVOICE", "INVOICE NO"])),
    ("INVOICE_SINGLE_PARTY", dict(all=["SGST", "CGST", "HSN"])),
    ("QUARTERLY_SUMMARY", dict(any=["QUARTERLY", "QTR", "Q1", "Q2", "Q3", "Q4", "AMT OCT", "AMT NOV", "AMT DEC"])),
    ("QUARTERLY_SUMMARY", dict(months=True)),
    ("SALES_ANALYSIS_SUMMARY", dict(all=["SALES ANALYSIS", "ALL PARTIES"])),
    ("SUMMARY", dict(any=["COMPANY WISE CUSTOMER SALES"])),
    ("CUSTOMER_PRODUCT_SALES", dict(any=["CUSTOMER COMPANY AND PRODUCT SALES"])),
    ("CUSTOMER_WISE_PRODUCT_WISE", dict(compact=["CUSTOMERWISEPRODUCTWISE", "CUSTOMERPRODUCTWISE"])),
    ("MFR_CUSTOMER_SUMMARY", dict(compact=["MFRCUSTOMERWISESALES", "CUSTOMERWISESALESSUMMARY", "MFRCUSTOMERWISE",
                                           "GROUPVSCUSTOMER"])),
    ("PARTY_SALES_BOOK", dict(any=["PARTY WISE SALES BOOK"])),
    ("SALE_REGISTER_ITEMIZED", dict(any=["SALE REGISTER", "SALES REGISTER"], also=["QTY", "ITEM"])),
    ("SUMMARY", dict(any=["SALE REGISTER", "SALES REGISTER"])),
    ("SUMMARY", dict(any=["PARTY WISE SALE"])),
    ("PARTY_SALES_BOOK", dict(any=["AMOUNT N A M E", "AMOUNT NAME"])),
    ("PARTY_WISE", dict(any=["AREA ITEM"], compact=["AREAITEM"])),
    ("ITEM_WISE", dict(any=["ITEM PARTY"], compact=["ITEMPARTY"])),
    ("PARTY_PRODUCT_WISE", dict(any=["PARTY PRODUCTWISE"], compact=["PARTYPRODUCTWISE"])),
    ("PARTY_WISE", dict(any=["PARTY ITEM"], compact=["PARTYITEM"])),
    ("ITEM_WISE", dict(any=["ITEM WISE"], none=["PARTY", "AREA"])),
    ("SUMMARY", dict(any=["SALE SUMMARY", "AMT", "PAERIES", "SALE DATA", "RETAILER SALE", "SUMMARY", "DEALER"])),
]
LEGACY_DEFAULT = "UNIVERSAL_TWO_COLUMN"

# --- fixed values: delimited schemas; later entries are tried first ----------------------------
FIELDS = ["item_code", "area", "party_name", "product_name", "packing", "qty", "free_qty", "rate", "amount", "company",
          "gstin", "hsn", "batch", "expiry", "discount", "tax_pct"]
DELIMITED = [
    dict(format_id="BUSY_PARTY_PRODUCT_WISE", erp="BUSY", keywords=["BUSY", "PARTY WISE", "PRODUCT WISE"],
         columns=dict(party_name=0, product_name=1, packing=2, qty=3, free_qty=4, rate=5, amount=6, discount=7,
                      tax_pct=8), subtotal=r"(?i)\bsub\s*total\b"),
    dict(format_id="BUSY_SALE_REGISTER", erp="BUSY", keywords=["BUSY", "SALE REGISTER"],
         columns=dict(party_name=0, product_name=2, qty=3, rate=4, amount=5, gstin=6, hsn=7, tax_pct=8),
         subtotal=r"(?i)\bsub\s*total\b"),
    dict(format_id="GOFRUGAL_DIST_SALES", erp="GOFRUGAL", keywords=["GOFRUGAL"],
         columns=dict(product_name=0, hsn=1, batch=2, expiry=3, qty=4, free_qty=5, rate=6, amount=7, tax_pct=8),
         subtotal=r"(?i)\b(subtotal|sub\s*total)\b"),
    dict(format_id="GOFRUGAL_PARTY_WISE", erp="GOFRUGAL", keywords=["GOFRUGAL", "PARTY WISE"],
         columns=dict(party_name=0, area=1, qty=2, free_qty=3, rate=4, amount=5, discount=6, tax_pct=7),
         subtotal=r"(?i)\bsub\s*total\b"),
    dict(format_id="MEDICIN_STOCK_STATEMENT", erp="MEDICIN", keywords=["MEDICIN"],
         columns=dict(item_code=0, product_name=1, company=2, packing=3, qty=4, rate=5, amount=6, batch=7, expiry=8),
         subtotal=r"(?i)\btotal\b"),
]
GRAND_TOTAL = r"(?i)\b(grand\s*total|net\s*payable|total\s*value)\b"

# --- fixed values: probe templates (column, type, weight) --------------------------------------
PROBE_TEMPLATES = {
    "FLAT_PARTY_PRODUCT": [(0, "text", 1.0), (1, "text", 0.8), (2, "text", 0.5), (3, "drug", 1.5), (4, "packing", 1.0),
                           (5, "integer", 0.8), (6, "integer", 0.6), (7, "amount", 1.0), (8, "amount", 1.5),
                           (9, "company_tag", 1.2)],
    "PARTY_WISE_SUMMARY": [(0, "text", 1.0), (1, "integer", 1.0), (2, "amount", 1.5)],
    "BUSY_PARTY_PRODUCT_WISE": [(0, "text", 1.0), (1, "drug", 1.2), (2, "packing", 0.8), (3, "integer", 0.8),
                                (4, "integer", 0.5), (5, "amount", 1.0), (6, "amount", 1.5), (7, "gstin", 1.2),
                                (8, "integer", 0.5)],
    "GOFRUGAL_DIST_SALES": [(0, "drug", 1.5), (1, "hsn", 1.2), (2, "text", 0.8), (3, "date", 1.0), (4, "integer", 0.8),
                            (5, "integer", 0.5), (6, "amount", 1.0), (7, "amount", 1.5), (8, "integer", 0.5)],
    "PAGED_STORE_INVOICE": [(0, "integer", 0.8), (1, "date", 1.2), (2, "text", 1.0), (3, "gstin", 1.5),
                            (4, "amount", 1.2), (5, "amount", 1.0), (6, "amount", 0.8), (7, "amount", 0.8)],
    "SALES_BOOK_REGISTER": [(0, "integer", 0.8), (1, "date", 1.2), (2, "text", 1.0), (3, "amount", 1.5),
                            (4, "amount", 1.0)],
    "MEDICIN_STOCK_STATEMENT": [(0, "text", 0.8), (1, "drug", 1.5), (2, "text", 0.8), (3, "packing", 0.8),
                                (4, "integer", 0.8), (5, "amount", 1.0), (6, "amount", 1.5), (7, "text", 0.8),
                                (8, "date", 0.8)],
}
PROBE_TYPES = ["amount", "gstin", "date", "company_tag", "drug", "packing", "hsn", "integer", "text"]

# --- fixed values: column roles and their header words, in registry order ----------------------
ROLE_SYNONYMS = [
    ("store", ["PARTY NAME", "STORE NAME", "STORENAME", "CUSTOMER NAME", "CUSTOMER", "CLIENT NAME", "PARTY", "M/S",
               "RETAILER", "CHEMIST", "PHARMACIST", "DEALER", "BUYER", "CONSIGNEE", "SHOP NAME", "FIRM NAME"]),
    ("amount", ["BILL AMT", "BILL AMT.", "BILL AMOUNT", "AMOUNT", "NET AMOUNT", "NET SALE", "NET SALES", "SALE AMOUNT",
                "VALUE", "TOTAL", "NET VALUE", "SALE VALUE", "INVOICE AMOUNT", "INV AMT"]),
    ("date", ["DATE", "BILL DATE", "INVOICE DATE", "INV DATE", "SALE DATE", "TRANS DATE", "VOUCHER DATE", "TXN DATE"]),
    ("bill_no", ["BILL NO", "BILL NO.", "BILL NUMBER", "INVOICE NO", "INVOICE NO.", "INV NO", "VOUCHER NO", "DOC NO",
                 "REF NO"]),
    ("item", ["ITEM", "ITEM NAME", "PRODUCT", "PRODUCT NAME", "DESCRIPTION", "DESC", "BRAND", "BRAND NAME", "DRUG NAME",
              "MEDICINE"]),
    ("qty", ["QTY", "QUANTITY", "UNITS", "PCS", "PIECES", "NOS"]),
    ("free", ["FREE", "FREE QTY", "FREE UNITS", "BONUS"]),
    ("rate", ["RATE", "SALE PR", "SALE PRICE", "PRICE", "MRP", "UNIT PRICE"]),
    ("taxable", ["TAXABLE", "TAXABLE AMT", "TAXABLE AMOUNT", "TAXABLE VALUE", "BASIC"]),
    ("tax", ["TAX", "GST", "CGST", "SGST", "IGST", "TAX AMT", "TAX AMOUNT"]),
    ("sur_tax", ["SUR TAX", "SUR. TAX", "SURTAX", "ADDITIONAL TAX", "CESS"]),
    ("location", ["PLACE", "LOCATION", "CITY", "AREA", "ADDRESS", "STATION", "DISTRICT"]),
    ("exempted", ["EXEMPTED", "EXEMPT", "NIL RATED", "NON TAXABLE"]),
    ("round_off", ["R.OFF", "ROUND OFF", "ROUND", "ROUNDING"]),
    ("hsn", ["HSN", "HSN CODE", "HSN NO", "SAC CODE"]),
    ("batch", ["BATCH", "BATCH NO", "BATCH NO.", "LOT NO", "MFG BATCH"]),
    ("expiry", ["EXP", "EXP DATE", "EXPIRY", "EXPIRY DATE", "EXPIRE"]),
    ("discount", ["DISC", "DISCOUNT", "DISC AMT", "DISC %", "REBATE", "CD"]),
    ("serial", ["SL", "SR", "SR NO", "SR.", "S.NO", "SL NO", "NO."]),
]
NUMERIC_ROLES = ["amount", "taxable", "tax", "sur_tax", "exempted", "round_off", "qty", "free", "rate", "discount", "free_amt"]

FLAT_READER_HEADERS = [
    r"(?i)Party\s+Name\s+Product\s+Qty\s+Free\s+Rate\s+Amount",
    r"(?i)Area\s+Party\s+Name\s+Product",
    r"(?i)Product\s+Qty\s+Free\s+Rate\s+Amount",
    r"(?i)Particulars?\s+Qty\s+Rate\s+Amount",
]


def role_keys() -> list[tuple[str, str]]:
    """(key, role) for each header word in letters-and-digits form; a later role overwrites an earlier one."""
    keys: dict[str, str] = {}
    for role, words in ROLE_SYNONYMS:
        for word in words:
            keys["".join(ch for ch in word if ch.isalnum())] = role
    return list(keys.items())


def phrases() -> list[str]:
    """Header words of more than one word, longest first (stable)."""
    return sorted((w for _, words in ROLE_SYNONYMS for w in words if " " in w), key=len, reverse=True)
