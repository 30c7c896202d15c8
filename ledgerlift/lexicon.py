"""Word lists and patterns.

Every list in this module is a fixed value: results depend on these exact words,
so they are stated as plain text, together, in natural order. Patterns are
written for Java regular expressions (what Spark's rlike / regexp_* take).
"""

# --- fixed values: trade words -------------------------------------------------------------
TRADE_ROOTS = (
    r"(?:MEDICALS?|MEDICAAL|MEDICAL\s*&|MEDICINES?|MEDICOS?E?|MEDICARE|MEDICATES?|MEDCLS?|MEDI|MED\.?|PHARMACY|"
    r"PHARMAA?|PHRM|PHARMACEUTICALS?|DRUGS?|DRUGGISTS?|CHEMISTS?|AYURVEDIC|SURGICALS?|VETERINARY|VET|DENTAL|"
    r"AUSHADHI|AUSHADHALAYA|LIFE\s*CARE|HEALTH\s*CARE|CLINIC|HOSPITAL|POLYCLINIC|DAWAKHANA)"
)
AGENCY_ROOTS = (
    r"(?:AGENC(?:Y|IES)|COMPANY|CO\.?|TRADERS?|TRADING|DISTRIBUTORS?|DISTRIBUTERS?|DISTRIBUTION|DIST\.?|SUPPLIERS?|"
    r"SUPPLY|ENTERPRISES?|CORPORATION|CORP\.?|SONS|BROTHERS|BROS|TRUST|FOUNDATION|INSTITUTE|ASSOCIATES?|SERVICES?)"
)
TRADE_MODIFIERS = (
    r"(?:\s*(?:&|AND|OR|\\+|-)?\s*(?:GENERAL|GENARAL|GENREAL|GENRAL|GEN\.?|FANCY|FANCEY|FANC|PROVISION|PROV|"
    r"SUPER\s*SPECIALITY))?"
)
SHOP_WORDS = (
    r"(?:STORES?|STORTE?|STORE?S?|STOR|STO|ST|SHOPPES?|SHOP|MART|POINT|CENT(?:ER|RE)|DEPOT|CORNER|HUB|NETWORK|HALL|"
    r"BHANDAR|KENDRA|PALACE)"
)
TRADE_TAIL = r"(?:[';/sS]+|/S|'S|;S|S)?"
TRADE_CORE = rf"(?:{TRADE_ROOTS}{TRADE_MODIFIERS}(?:\s*{SHOP_WORDS})?|{AGENCY_ROOTS}|{SHOP_WORDS})"
TRADE_WORD = rf"(?i)\b({TRADE_CORE}{TRADE_TAIL})(?:\b|(?=[A-Z0-9]))"
AGENCY_PHRASE = (
    rf"(?i)\b(?:PHARMA\s+|PHARMACEUTICALS\s+)?{AGENCY_ROOTS}\b(?:(?:\s+(?:PVT|PRIVATE)\s+LTD)|(?:\s+LTD))?\b"
)
CORPORATE_WORD = (
    r"\b(?:LTD\.?|PVT\.?|LIMITED|PRIVATE|COMPANY|CO\.?|GEN|GENERICS?|LIFE\s*SCIENCES?|PHARMA(?:CEUTICALS?)?|"
    r"INC\.?|CORP(?:ORATION)?\.?)\b"
)
GLUED_TRADE_WORD = (
    r"(?i)([A-Za-z])(MEDICALS?|PHARMACY|PHARMA|MEDICOS?|AGENCIES|AGENCY|CLINIC|HOSPITAL|DRUGS?|CHEMISTS?)\b"
)
DOCTOR = r"(?i)^(?:DR\.?\s+|DOCTOR\b)"
DEGREE = (
    r"\b(?:M\s*B\s*B\s*S|M\.?\s*D\.?|M\.?\s*S\.?|B\.?\s*D\.?\s*S\.?|B\.?\s*A\.?\s*M\.?\s*S\.?|B\.?\s*H\.?\s*M\.?\s*S\.?)\b"
)
HEADING_SHOP_WORD = (
    r"\b(?:STORES?|MART|HALL|POINT|CENT(?:ER|RE)|DEPOT|CORNER|HUB|NETWORK|BHANDAR|KENDRA|PALACE|SHOP|AGENC(?:Y|IES)|"
    r"TRADERS?|TRADING|DISTRIBUTORS?|ENTERPRISES?|CORPORATION|SUPPLIERS?|BROTHERS|BROS|ASSOCIATES?|SERVICES?|COMPANY)\b"
)
FLAT_STORE_WORD = (
    r"(?i)\b(MEDICAL|MEDICALS|MEDICOS|DRUG|PHARMA|STORE|HALL|AGENCY|HOUSE|ENTERPRISES?|DAWAGHAR|DANAGHAR|MEDIC)\b"
)
# words that mark an agency line in a report header
AGENCY_NAME_WORDS = [
    "AGENCY", "AGENCIES", "COMPANY", "TRADERS", "TRADING", "DISTRIBUTORS", "DISTRIBUTOR", "ENTERPRISES", "ENTERPRISE",
    "CORPORATION", "CORP", "PHARMA", "MEDICAL", "MEDICALS", "MEDICOS", "MEDICOSE", "DRUG", "CHEMIST", "SUPPLIERS",
    "SUPPLY", "M/S",
]

# --- fixed values: brand and corporate words removed from a location ------------------------
BRANDS = [
    "ALKEM", "ARISTO", "ABBOTT", "CIPLA", "COMPANY", "GEN", "GENERICS", "GLENMARK", "GSK", "INTAS", "LIFE SCIENCES",
    "LILITED", "LIMITED", "LIPIN", "LTD", "LTD.", "LUPIN", "LUPIN LTD", "LUPIN LIMITED", "LUPIN(G)", "MACLEODS",
    "MANKIND", "MICRO LABS", "NOVARTIS", "PFIZER", "PRIVATE LIMITED", "PVT", "PVT LTD", "PVT.", "SANOFI", "SUN PHARMA",
    "TORRENT", "USV", "ZYDUS",
]

# --- fixed values: OCR corrections ----------------------------------------------------------
STORE_SPELLINGS = [
    (r"(?i)\bNTERPRISES?\b", "ENTERPRISES"),
    (r"(?i)\bNTERPRI(S|Z)E?S?\b", "ENTERPRISES"),
    (r"(?i)\bICAL\b", "MEDICAL"),
    (r"(?i)\bMEDICLS\b", "MEDICALS"),
    (r"(?i)\bMEDCLS?\b", "MEDICALS"),
    (r"(?i)\bMEDL\b", "MEDICAL"),
    (r"(?i)\bPHARMAA\b", "PHARMA"),
    (r"(?i)\bPHRM\b", "PHARMA"),
    (r"(?i)\bAGENC(Y|IES)\b", "AGENCY"),
    (r"(?i)\bDISTRIBUTERS?\b", "DISTRIBUTOR"),
]
# (pattern, replacement, fields it applies to)
FIELD_NOISE = [
    (r"(?<=\d)O(?=\d)", "0", ("Amount", "Rate", "Qty")),
    (r"(?<=[A-Z])0(?=[A-Z])", "O", ("Description",)),
    (r"\bI(?=\d{3,})", "1", ("Amount", "Rate")),
    (r"(?<=\d)l(?=\d)", "1", ("Amount", "Rate")),
    (r"\bS(?=\d{3,})", "5", ("Amount",)),
    (r"(?i)\bLUPISULIDE\s*-\s*P\b", "LUPISULIDE-P", ("Description",)),
    (r"(?i)\bHEPP\s+FORT\b", "HEPP FORT", ("Description",)),
    (r"(?i)\bONECLAV\s+625\b", "ONECLAV 625", ("Description",)),
    (r"(?i)\bPANTOLUP\s+DSR\b", "PANTOLUP DSR", ("Description",)),
    (r"(?i)\bLUPICEF[\s\-]*O\b", "LUPICEF-O", ("Description",)),
    (r"(?i)\bXIMECEF+\b", "XIMECEFF", ("Description",)),
    (r"(?i)\bMEDICAL\s+L\b", "MEDICALS", ("StoreName",)),
    (r"(?i)\bMEDICLS\b", "MEDICALS", ("StoreName",)),
    (r"(?i)\bDRUGSTORE\b", "DRUG STORE", ("StoreName",)),
    (r"(?i)\bMEDlCAL\b", "MEDICAL", ("StoreName",)),
    (r"(?i)\bNTERPRISES?\b", "ENTERPRISES", ("StoreName", "StoreLocation")),
    (r"(?i)\bICAL\b", "MEDICAL", ("StoreName",)),
    (r"(?i)\bMEDCLS?\b", "MEDICALS", ("StoreName",)),
    (r"(\d+\.\d{2})\s*[A-Z]{2,}$", "$1", ("Amount",)),
]
CUSTOMER_MISSPELLINGS = r"(?i)\b(comer|custmer|cstmer|custmr|cstomer)\b"
# letter read for digit, as parallel strings for translate()
CONFUSED_LETTERS, CONFUSED_DIGITS = "OlISBZsg", "01158259"

# --- fixed values: products ------------------------------------------------------------------
KNOWN_PRODUCTS = {
    "LUPISULIDE P TAB": "LUPISULIDE-P TAB(AMB)",
    "LUPISULIDE P GE": "LUPISULIDE-P(GE)",
    "LUPISULIDE P GF": "LUPISULIDE-P(GF)",
    "HEPP FORT SYP": "HEPP FORT SYP",
    "LUPICEF 0 200MG TAB": "LUPICEF-O 200MG TAB",
    "XIMECEFF O 200 TAB": "XIMECEFF O 200 TAB.",
    "ONECLAV 625 TAB": "ONECLAV 625 TAB.",
    "PANTOLUP DSR CAP": "PANTOLUP DSR CAP",
    "AZILUP 250 TAB": "AZILUP 250 TAB",
    "AZILUP 500 TAB": "AZILUP 500 TAB.",
    "REVEAL KIT": "REVEAL KIT",
    "MEGARICH CAP": "MEGARICH CAP",
    "BILALUP M TAB": "BILALUP M TAB.",
    "CEFPOLUP 100 DRY SYP": "CEFPOLUP 100 DRY SYP",
    "CEFPOLUP 200 TAB": "CEFPOLUP 200 TAB.",
}
# product stems: header sampling, column probing, flat rows, flat detection
STEMS_FEATURE = [
    "HEPP", "LUPI", "ONECLAV", "DEFENAC", "BILALUP", "REVEAL", "CEFP", "MEGARICH", "PANTOLUP", "AZILUP", "CIPROVA",
    "LUPICEF", "XIMECEF", "FLUCALUP",
]
STEMS_PROBE = [
    "HEPP", "ONECLAV", "DEFENAC", "REVEAL", "CEFP", "MEGARICH", "CIPROVA", "XIMECEF", "AMOX", "CEFO", "METFO", "ATORV",
    "AZITHRO", "PANTO", "OMEP", "CETIRIZ", "PARACET", "IBUPROF",
]
STEMS_FLAT_ROW = [
    r"HEPP\s*FORT", "LUPISULIDE", "LUPICEF", "LUPIZYME", "LUPISERA", "LUPICREPE", "LUPIDINE", "LUPIPORE", "ONECLAV",
    "DEFENAC", "BILALUP", r"REVEAL\s*KIT", "CEFPOLUP", "CEEPOLUP", "MEGARICH", "PANTOLUP", "AZILUP", "CIPROVA",
    "XIMECEF+", "FLUCALUP", "SOLUBET", "MULTIRICH", "CANAZOLE", r"PILES\s*CURE", r"SURGICAL\s*TAPE", "CEFFOREN",
    "LUPIZYE", "LUPIZME", "HEPP",
]
STEMS_FLAT_DETECT = [
    r"HEPP\s*FORT", "ONECLAV", "DEFENAC", "REVEAL", "MEGARICH", "CIPROVA", "XIMECEF", "SOLUBET", "MULTIRICH",
    "CANAZOLE", r"PILES\s*CURE", "CEFFOREN",
]
COMPANY_TAGS = [
    "LUPIN", "CIPLA", "SUNPHARMA", "ALKEM", "MACLEODS", "ZYDUS", "PFIZER", "ABBOTT", "GSK", "MANKIND", "DRL",
]


def stem_pattern(stems) -> str:
    return r"(?i)\b(?:" + "|".join(stems) + r")\w*"


# item description parsing
PACK = r"\b(\d+\s*[xX\*]\s*\d+[A-Z]*|\d+'?[sS])\b"
DOSE = (
    r"(?i)\b(\d+(?:\.\d+)?\s*(?:MG|ML|GM|MCG|TAB|CAP|INJ|SYP|DROP|IU|STRIP|CM|INCH|MTR|MM|\"|''?|”|″))(?=\s|$|\W)"
)
INCH_MARK = r"(?i)\b\d+\s*(?:\"|''?|”|″|INCH|CM|MM)"
DESCRIPTION_NOISE = [
    "EXP", "EXPT", "EXPD", "EXPIRY", "QTY", "QUANTITY", "MFG", "MFR", "MNF", "MNP", "BATCH", "BAT", "BATNO", "BATCHNO",
    "BNO", "MESSAGE", "MSG", "SMS", "MESS", "NRP", "MRP", "RATE", "AMOUNT", "AMT", "DISC", "DISCOUNT", "GST", "CESS",
    "ED", "SURCHARGE", "TOTAL", "FR", "FREE", "TAXABLE", "TAX", "SGST", "CGST", "IGST", "ROUND", "ROUNDED", "ROUNDOFF",
    "NET", "GROSS", "SL", "SR", "CODE", "HSN",
]
FORM_SUFFIXES = [
    "TAB", "CAP", "INJ", "SYP", "DROP", "GEL", "OIN", "LOT", "CRM", "SPR", "NAS", "SUS", "PWD", "SOL", "CREAM",
]
DOSE_WORDS = ["TAB", "CAP", "SYP", "INJ", "DROP", "CREAM", "OINT", "GEL"]
PACK_WORDS = ["TAB", "CAP", "SYP", "INJ", "DROP", "ML", "GM", "LTR"]
FLAT_PACK = (
    r"(?i)\b\d{1,3}\s*[*xX]\s*\d+\b|\b1\s*[xX]\s*\d+\s*(?:GM|ML|TAB)?\b|\b\d+\s*(?:ML|GM|MG|TAB|CAP|SYP|INJ)\b|"
    r"\b\d+\s*CM\s*[xX]\s*\d+\s*MT?\b"
)
DOSAGE_HINT = r"(?i)\b\d+\s*(?:MG|ML|GM|MCG|TAB|CAP|INJ|SYP)\b"
DOSAGE_IN_STORE = r"(?i)\b\d{1,4}\s*(ML|TAB|CAP|GM|INJ|SYP)\b"
PACK_INFO = (
    r"(?i)\d+\s*(?:\*|x|X)\s*\d+|,\s*\d|\b\d{1,4}\s*(?:ML|TAB|CAP|GM|INJ|SYP|DROP|S|CM|INCH|MM)\b"
)

# --- fixed values: line classes --------------------------------------------------------------
TOTAL_LINE = (
    r"(?i)(grand\s*total|total\s*value|net\s*sales|value\s*in\s*rs|net\s*amount|total\s*[:.]|invoice\s*value|"
    r"net\s*payable|total\s+[\d.,]+\s*$|^\s*[\d.,]+\s+total\s*$)"
)
TOTAL_LABELS = [
    "grand total", "total value", "net sales", "value in rs", "net amount", "total:", "total :", "invoice value",
    "net payable",
]
BLOCK_WORDS = [
    "total :", "total:", "grand total", "net sales", "net sale", "total value", "total amount", "end of report",
    "total qty", "value in rs", "net amount", "invoice value", "net payable", "gross amount", "sub total", "subtotal",
    "taxable amt", "taxable amount", "grandtotal", "g.total", "total rs", "page total", "report total", "total sale",
    "total sales", "tot.",
]
MODIFIER_WORDS = [
    "c.g.s.t", "s.g.s.t", "i.g.s.t", "cgst", "sgst", "igst", "gst 5%", "gst 12%", "gst 18%", "gst 28%", "gst free",
    "taxable value", "coin adjustment", "round off", "discount", "disc.", "less :",
]
SKIP_HEADERS = [
    "continued..", "page no", "report for", "company :", "company:", "d e s c r i", "description", "shop no",
    "area / item", "summary from", "party/item", "party / item", "sale summary", "party wise sale",
    "name of the party", "party name", "amt.october", "amt.november", "amt.december", "party/customer",
    "party / customer", "free amt", "packs", "party-productwise", "party-productwise sales", "party wise sales book",
    "amount name", "amount party", "sales analysis", "all parties", "account details", "product name", "inv/dm no",
    "company wise customer sales", "netamount", "town name", "name town", "net amount", "amount n a m e",
    "computerise your", "customer name", "goods value", "gst amount", "proddisc amt", "cdis amt",
]
TABLE_TRIGGERS = [
    "DESCRIPTION", "TOTALVALUE", "NAMEOFTHEPARTY", "PARTY/CUSTOMER", "AMOUNTNAME", "ACCOUNTDETAILS", "PRODUCTNAME",
    "PAERIES", "NETAMOUNT", "PARTYNAME", "SALEPR", "GROUP/CUSTOMER", "GROSSVAL", "NETVALUE", "HSNCODE", "SLITEM",
    "PRODUCTBATCH", "PACKQTY", "HSNMRP", "PRODUCT", "HSN", "MRP", "BATCH", "EXP.", "STORENAME", "STORELOCATION",
    "BRANDNAME", "FREEUNITS", "DISCOUNT", "BILLNO", "INVOICENO", "INVOICEDATE", "NETTSALEAMT", "AVGPRICE", "NOOFVCH",
    "TAXPAYABLE", "DRCR", "SALEAMT", "SALAMT", "SALENET", "SALESVALUE", "MOBILENO", "GOODSVALUE", "GSTAMOUNT",
    "PRODDISC", "CDISAMT", "FREEAMOUNT", "PACKS", "PACKING",
]
TAX_BLOCK_WORDS = [
    "tax details", "rupees in words", "bank details", "terms & conditions", "amount in words", "total gst",
    "sgst payble", "cgst payble",
]
FOOTER_WORDS = [
    "software by", "customer care", "authorised signatory", "e.&o.e", "page 1 of", "e.& o.e", "computerised",
    "computerise your", "www.", ".com", "powered by",
]
ADJUSTMENT_WORDS = [
    "cgst", "sgst", "igst", "c.g.s.t", "s.g.s.t", "i.g.s.t", "add gst", "gst tax", "gst heads", "tax details",
    "taxable", "round off", "roundoff", "tcs", "net payable", "total balance", "rupees ", "less c.d", "less cd",
    "discount", "disc.", "disc ",
]
TOTAL_DESCRIPTIONS = ["grand total", "grandtotal", "g.total", "total amount", "page total", "net amount"]
TAX_WORDS = ["cgst", "sgst", "igst", "c.g.s.t", "s.g.s.t", "i.g.s.t"]
INVOICE_HINT_WORDS = ["cgst", "sgst", "igst", "c.g.s.t"]
DISCOUNT_WORDS = ["discount", "disc.", "less", "disc "]
REGISTER_STOP_WORDS = ["GRAND TOTAL", "TOTAL :", "TOTAL", "NET TOTAL", "PAGE TOTAL", "*** END", "SUB TOTAL", "PAGE SUB"]
PAGE_ARTIFACT = r"(?i)^(?:-?\d+\s*-?\s*$|page\s+\d+|continued\.\.\.?|contd\.?)"

DATE = r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
DATE_LIKE = r"\b\d{1,2}[-/]\d{1,2}(?:[-/]\d{2,4})?\b"
GSTIN = r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z\d]\b"
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
QUARTER_WORDS = ["Q1", "Q2", "Q3", "Q4", "QTR", "QUARTERLY"]

# --- fixed values: store abbreviations written out ------------------------------------------
STORE_ABBREVIATIONS = [
    (r"\bDR\b", "Dr."), (r"\bMED\b", "Medical"), (r"\bPHAR\b", "Pharmacy"), (r"\bPH\b", "Pharmacy"),
    (r"\bAGCY\b", "Agency"), (r"\bDIST\b", "Distributor"), (r"\bCORP\b", "Corporation"), (r"\bENT\b", "Enterprises"),
    (r"\bPVT\b", "Pvt."), (r"\bLTD\b", "Ltd."),
]

# --- fixed values: vendors by ordered patterns (first match wins) ----------------------------
VENDORS = [
    ("LUPIN", [r"\bLUPIN\b", r"\bLUP\s*\d{4}\b", r"Lupin\s+(Park|Campus|Center|House)"]),
    ("APEX", [r"\bAPEX\b", r"Apex\s+(Laboratories|Pharma|Drugs)"]),
    ("SKY", [r"\bSKY\b", r"Sky\s+(Pharma|Health|Life)"]),
    ("ENCURE", [r"\bENCURE\b", r"Encure\s+Pharmaceuticals"]),
    ("FLAT", [r"Party\s+Name\s+Product\s+Qty", r"Area\s+Party"]),
    ("GENERIC", [r"(?:TAX\s+)?INVOICE", r"Bill\s+No", r"GST\s+(?:IN|No)"]),
]

# --- fixed values: what is scrubbed from descriptions, store names and locations, in order ---
LEADING_COLUMN_WORDS = (
    r"^(?:\s*(?:EXP(?:IRY)?\.?\s*|MFG\.?\s*|BATCH(?:\.?\s*NO\.?)?\s*|HSN(?:\s*CODE)?\.?\s*|GSTIN?\s*|MRP\.?\s*|RATE\.?\s*|"
    r"QTY\.?\s*|FREE\.?\s*|AMOUNT\.?\s*|AMT\.?\s*|DISC(?:OUNT)?\.?\s*|FR(?:EE)?\.?\s*|TAX(?:ABLE)?\.?\s*|SGST\.?\s*|"
    r"CGST\.?\s*|IGST\.?\s*|NET\.?\s*|GROSS\.?\s*|TOTAL\.?\s*|ROUND(?:ED)?(?:\s+OFF)?\.?\s*|CODE\.?\s*|NO\.?\s*|SL\.?\s*|"
    r"SR\.?\s*|[A-Z]{1,3}\s*\d{1,2}\s*%)+)+"
)
DESCRIPTION_SERIALS = [
    (r"^\s*\d{1,4}[\.\)\-]+\s+", ""),
    (r"^(?!\s*(?i:24|3D|5D|A2Z|B12|A\s*2\s*Z)\b)\s*\d{1,3}\s+(?=[A-Za-z])", ""),
]
DESCRIPTION_SCRUBS = [
    (r"[*.\-=,]{2,}", " "),
    (r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", " "),
    (r"(?i)\b(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s*'?-?\s*\d{2,4}\b", " "),
    (r"\b\d{1,2}\s*%\b", " "),
    (r"\b(?!\d+\s*[xX\*]\s*\d+[A-Z]*\b)(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*\d{3})[A-Z0-9]{6,15}\b", " "),
    (r"\b\d{4,6}[A-Z]{1,3}(?:\s+[A-Z]{1,3})?\b", " "),
    (r"\b[A-Za-z]{0,4}\d{4,8}\b", " "),
    (r"^\s*[A-Z]\s+(?=[A-Za-z]{3,})", ""),
    (r"^\s*[A-Za-z]\s*\d{3,6}\b", " "),
    (r"\b[A-Z]\s*\d{3,6}\s*$", " "),
    (AGENCY_PHRASE, ""),
]
GLUED_SCRUBS = [
    (r"([A-Za-z]{3,})(\d{1,2}[/\-\.\|]\d{2,4})\b", "$1 $2"),
    (r"\b(\d{1,2}[/\-\.\|]\d{2,4})([A-Za-z]{3,})", "$1 $2"),
    (r"([A-Za-z]{3,})(\d+\s*[xX\*]\s*\d+)\b", "$1 $2"),
    (r"[\(\[\{<].*?[\)\]\}>]", " "),
]
STORE_SCRUBS = [
    (r"^[A-Z0-9]+\s*-\s*", ""),
    (r"[\(\[\{<].*?[\)\]\}>]", " "),
    (r"(?is)(?:\bDL\.?\s*NO|\bGST|\bTIN|\bMOB|\bPH:|\bINV\b).*$", ""),
    (r"\b\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}\b", " "),
    (r"(?i)\bDATE\b", " "),
]
LOCATION_SCRUBS = [
    (r"\b\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}\b", " "),
    (TRADE_WORD, ""),
    (AGENCY_PHRASE, ""),
]


def any_of(words) -> str:
    """One alternation for a list of literal words (quoted, so dots and pluses stay literal)."""
    return "|".join(r"\Q" + w + r"\E" for w in words)
