import os

from pyspark.sql import functions as F

from ledgerlift.catalog.quality import received_summary
from ledgerlift.sources.received import receive_folder, received


def test_files_of_a_folder(spark, tmp_path):
    os.makedirs(tmp_path / "deep")
    good = "PARTY\tAMOUNT\nżółw\t1.00"
    for name, content in {"a.csv": good.encode(), "deep/b.CSV": b"x", "empty.csv": b"", "c.csv": b"\xff\xfe\x00", "d.txt": b"no such type"}.items():
        (tmp_path / name).write_bytes(content)
    base = f"file:{tmp_path}"
    asked = spark.createDataFrame([(f"{base}/a.csv",), (f"{base}/gone.csv",), (f"{base}/gone.csv",), (f"{base}/empty.csv",), (None,)], "path string")
    found = {r.source_file: (r.extension, r.n_chars, r.error, r.text) for r in receive_folder(spark, str(tmp_path), asked).collect()}
    assert found == {"a.csv": ("csv", len(good), None, good), "b.CSV": ("csv", 1, None, "x"), "empty.csv": ("csv", 0, "missing", None), "c.csv": ("csv", 0, "unreadable", None),
                     "gone.csv": ("csv", 0, "missing", None)}


def test_odd_rows(spark):
    rows = [("x/a.csv", 2, b"ab"), ("x/a.csv", 2, b"ab"), ("b.csv", 3, b"ab"), ("c.csv", 5, None), (None, 1, b"a"), ("none", 1, b"a"), ("void.csv", 0, b"")]
    files = spark.createDataFrame(rows, "path string, length long, content binary")
    found = sorted((r.doc_id, r.extension, r.error) for r in received(files).collect())
    assert [f[0] for f in found] == ["b.csv", "c.csv", "none", "void.csv", "x/a.csv"]
    assert [f[2] for f in found] == ["changed while read", "unreadable", None, None, None]
    assert received(files.limit(0)).collect() == []
    assert [r.error for r in received(files.limit(0), files.limit(1)).collect()] == ["missing"]


def test_all_verdicts_occur(spark, data):
    assert received_summary(spark, data).agg(F.countDistinct("status")).first()[0] == 7
