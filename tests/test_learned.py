"""The store of learned layouts over two runs, a replay, an unfinished version and the pipeline."""

from ledgerlift.operators import detect
from ledgerlift.operators.learned import read_learned, remember
from ledgerlift.plans.pipeline import process
from ledgerlift.sources import render

INFERRED = "doc_id string, key string, inferred struct<format_id:string,confidence:double,tier:int,source:string>"
KEYS = ["cols1_drugN_amtY", "cols1_drugN_amtN"]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_the_second_run_routes_by_what_the_first_learned(spark, data, tmp_path):
    folder = f"{tmp_path}/learned"
    assert read_learned(spark, folder) is None
    first = [(k, k, ("LEARNED_SUMMARY", 0.6, 2, "columns")) for k in KEYS] + [("x", KEYS[0], ("LESS", 0.58, 2, "columns")), ("y", "k", ("NO", 0.9, 1, "structure"))]
    first = spark.createDataFrame(first, INFERRED)
    assert remember(spark, folder, first) == 2 and remember(spark, folder, first) == 0  # a replay
    lines = render.summary_report(spark, data)
    again = detect.infer_layout(lines, read_learned(spark, folder)).select("inferred.*").distinct().collect()
    assert [(r.format_id, r.tier, r.source) for r in again] == [("LEARNED_SUMMARY", 3, "learned")]
    # known keys keep their layout, new ones are added
    more = spark.createDataFrame([("z", KEYS[0], ("OTHER", 0.9, 2, "columns")), ("z", "new", ("NEW", 0.7, 2, "columns"))], INFERRED)
    assert remember(spark, folder, more) == 1
    known = [(KEYS[1], "LEARNED_SUMMARY", 0.6), (KEYS[0], "LEARNED_SUMMARY", 0.6), ("new", "NEW", 0.7)]
    assert rows(read_learned(spark, folder)) == known
    # a version with rows missing does not count
    part = spark.createDataFrame([("a", "B", 0.7, 5)], "key string, format_id string, confidence double, n_rows long")
    part.write.parquet(f"{folder}/version=9/run=half")
    assert rows(read_learned(spark, folder)) == known


def test_the_pipeline_learns(spark, data, tmp_path):
    folder = f"{tmp_path}/learned"
    lines = render.delimited_statement(spark, data).where("doc_id = '1'")
    inferred = detect.infer_layout(lines).collect()
    assert [r.inferred.tier for r in inferred] == [2]  # by its columns
    process(lines, learned_folder=folder)
    assert rows(read_learned(spark, folder)) == [(inferred[0].key, inferred[0].inferred.format_id, inferred[0].inferred.confidence)]
