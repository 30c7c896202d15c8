"""One printed header per fingerprint must be recognised; whole small reports go through the pipeline."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlift import layouts as L
from ledgerlift.operators import detect
from ledgerlift.operators.headers import header_view
from ledgerlift.plans.pipeline import process
from ledgerlift.sources.lines import document_lines

SPECIAL = {"FORMAT_21": "STORE TOTAL JAN FEB", "FORMAT_07": "STORE JAN FEB TOTAL", "FORMAT_06": "AMOUNT STORE NAME"}


def test_every_fingerprint_has_a_header(spark):
    docs = []
    for rule in L.FINGERPRINTS:
        head = SPECIAL.get(rule["format_id"], " ".join(rule["all"]) + " " + " ".join(rule.get("any", [])[:1]))
        if rule.get("special") == "quarter_or_months":
            head += " QTR"
        docs.append((rule["format_id"], "RAM TRADERS\n" + head))
    got = {r.doc_id: r.f for r in header_view(document_lines(spark.createDataFrame(docs, "doc_id string, text string")))
           .withColumn("f", detect.fingerprint()).select("doc_id", "f").collect()}
    for rule in L.FINGERPRINTS:
        want = "FORMAT_01" if rule["format_id"] == "FORMAT_01_OR_02" else rule["format_id"]
        assert got[rule["format_id"]].format_id == want
        assert got[rule["format_id"]].report_type == rule["report_type"]


def test_pipeline_on_one_report(spark):
    text = "\f".join([
        "RAM TRADERS\nGSTIN : 29ABCDE1234F1Z5\n01-04-2024 TO 30-04-2024\nSTORENAME STORE LOCATION SALES RETURN AMOUNT\n"
        "1 SHARMA MEDICAL STORE, AMBALA 1,200.50", "1\nPage 2\n2 GUPTA\nPHARMACY KARNAL 800.00\nGRAND TOTAL 2,000.50"])
    lines = document_lines(spark.createDataFrame([("r1", text)], "doc_id string, text string"))
    out = process(lines)
    fact = {r["Store Name"]: r for r in out["fact"].collect()}
    assert fact["SHARMA MEDICAL STORE"]["Amount"] == Decimal("1200.50") and fact["SHARMA MEDICAL STORE"]["Store Location"] == "AMBALA"
    assert sum(r["Amount"] for r in fact.values()) == Decimal("2000.50")
    assert out["summary"].first()["Status"] == "Perfect Match"


def test_expected_heading_without_trade_word(spark):
    from ledgerlift.operators.extract_rows import doc_facts, register_items
    text = ("RAM TRADERS\nDATE BILLNO ITEM BATCH NO QTY FREE SALE PR AMOUNT EXP.DATE\nMOHAN LAL\n01-04-2024 B1 red pill 2 0 5.00 10.00\n"
            "TOTAL 10.00\nSOHAN LAL\n02-04-2024 B2 blue pill 1 0 7.00 7.00")
    lines = document_lines(spark.createDataFrame([("r1", text)], "doc_id string, text string"))
    got = register_items(lines, doc_facts(lines), expect_headings=True).select("store_name", "amount").collect()
    assert {(r.store_name, r.amount) for r in got} == {("MOHAN LAL", Decimal("10.00")), ("SOHAN LAL", Decimal("7.00"))}


def test_sources_and_sinks(spark, tmp_path):
    from ledgerlift.sources import lines as S, sinks
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x , y,,z\n\n1,2\n")
    (tmp_path / "in" / "b.txt").write_text("p1\fp2\nq")
    (tmp_path / "in" / "c.exe").write_text("no")
    assert [r.file_name for r in S.discover(spark, str(tmp_path / "in")).collect()] == ["a.csv"]
    assert sorted(r.text for r in S.read_delimited(spark, str(tmp_path / "in")).collect()) == ["1\t2", "x\ty\tz"]
    pages = S.document_lines(S.read_paged_text(spark, str(tmp_path / "in"))).orderBy("line_no").collect()
    assert [(r.page_no, r.text) for r in pages] == [(0, "p1"), (1, "p2"), (1, "q")]
    rows = spark.createDataFrame([(1, ["A", "B"]), (2, [])], "id int, flags array<string>")
    sinks.write_with_flagged(rows, str(tmp_path / "all"), str(tmp_path / "flagged"))
    back = spark.read.option("header", True).csv(str(tmp_path / "flagged")).collect()
    assert [(r.id, r["QA Flags"]) for r in back] == [("1", "A; B")]


def test_rate_limit_default(spark):
    from ledgerlift.operators.usage import rate_limited
    log = spark.range(30).select(F.lit("k").alias("api_key"), F.timestamp_seconds(F.col("id") * 2).alias("created_at"))
    assert [(r.n, r.over) for r in rate_limited(log).collect()] == [(30, 10)]


def test_no_document_is_lost(spark):
    rows = "\n".join(f"{name}\tPARACIP 500 TAB\t10*10\t{k + 2}\t{10 * k + 12}.50\t{100 * k + 125}.00"
                     for k, name in enumerate(["SHARMA STORES", "GUPTA STORES", "VERMA STORES", "KHANNA STORES", "MEHTA STORES"]))
    docs = [("inferred", f"RAM TRADERS\nAPRIL\n{rows}"),
            ("plain", "RAM TRADERS\nBUSY PARTY WISE PRODUCT WISE\nGUPTA MEDICAL STORE, KARNAL 2 1 800.00\nVERMA MEDICAL STORE, AMBALA 1 0 450.00"),
            ("empty", "nothing here")]
    out = process(document_lines(spark.createDataFrame(docs, "doc_id string, text string")))
    kinds = {r.doc_id: r.report_type for r in out["routed"].collect()}
    items = out["items"].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in items} >= {"inferred", "plain"}, (kinds, items)
    assert {r["Source File"] for r in out["qa"].collect()} == {"inferred", "plain", "empty"}
