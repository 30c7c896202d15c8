import corpus_pipeline
from ledgerlift.llm import catalog, jaccard, mixing, quality, templates
from ledgerlift.llm.common import keep


def test_stages_take_effect(spark, data, documents):
    docs = documents
    kept = {r.doc_id for r in quality.judged(docs, ["doc_id"]).filter("kept").collect()}
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = keep(stage(spark, docs, data), name)
        sizes.append(docs.count())
        ids = {r.doc_id for r in docs.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
        if name == "quality_rules":
            assert ids == kept
        elif name == "jaccard_join":
            groups = jaccard.jaccard_components(before, 5, 80).collect()
            assert ids == {r.component_id for r in groups}
        elif name == "decontamination":
            items = spark.read.parquet(f"{data}/benchmark.parquet")
            assert ids == {r.doc_id for r in before.collect()} - {r.doc.doc_id for r in templates.leaks(before, items).collect()}
        elif name == "mixing":
            assert ids == {r.doc_id for r in mixing.sampled(before, catalog.TARGETS, catalog.SHARE, catalog.TOKENIZER, ["doc_id"]).collect() if r.taken}
        else:
            assert ids == {r.doc_id for r in before.collect()}
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    whole = {tuple(r) for r in corpus_pipeline.run(spark, data).collect()}
    assert whole == {tuple(r) for r in docs.collect()}


def test_entry_registers_all():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
