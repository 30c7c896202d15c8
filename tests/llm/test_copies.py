import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlift.llm import jaccard, line_runs, templates
from ledgerlift.llm.components import components

from .helpers import DOC, ODD, linked, without_repeats


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 90, jaccard.BLOCK_TERMS), (5, 80, 400)])
def test_jaccard_components(spark, documents, width, percent, block):
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    words = [f"w{k}" for k in range(90)]
    for k in range(60):  # a family of near copies, cut into several blocks by the small block size
        own = words[:rng.randint(70, 90)]
        own[rng.randrange(60)] = f"x{k}"
        rows.append((10_000 + k, " ".join(own)))
    rows += [(20_000, "A b"), (20_001, "a B"), (20_002, ""), (20_003, None), (20_004, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("signature", F.lit(1))
    found = jaccard.jaccard_components(docs, width, percent, block).collect()
    assert {tuple(r) for r in found} == linked(rows, width, percent) and len(found) == len(rows)


def test_jaccard_odd_rows(spark):
    found = Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(ODD, DOC)).collect())
    assert found == Counter({(None, 0, None): 1, (1, 0, 1): 1, (2, 0, 2): 1, (2, 1, 2): 2})
    assert jaccard.jaccard_components(spark.createDataFrame([], DOC)).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 40), (40, 50), (60, 60), (45, 50)]
    found = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(k, 0) for k in range(31)} | {(40, 40), (45, 40), (50, 40)}


def test_line_runs(spark):
    rng = random.Random(3)
    lines = ["a a a", "b b b b b", "c", "d d d d d d d", "e e", "f f f f"]
    rows = [(None, None), (0, ""), (1, "a\n\nb")]
    rows += [(i, "\n".join(rng.choice([*lines, "", f"x{rng.randint(0, 50)}"]) for _ in range(rng.randint(0, 14)))) for i in range(2, 60)]
    block = "\n".join(lines[:5])
    rows += [(None, block), (None, block), (5, block)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("doc", F.lit(1))
    found = line_runs.without_repeats(docs, 15).collect()
    expected = without_repeats(rows, 15)
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], expected[r]) for r in rows)
    assert sum(r.n_removed for r in found) > 0
    assert line_runs.without_repeats(docs.limit(0)).collect() == []


QUESTION = "Yesterday Tom had 5 apples and gave 3 apples to Mary before walking 12 km home with Tom at 5 pm."


def test_templates(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, QUESTION), (3, "too short"), (4, None)], "item_id long, text string")
    rows = [(1, f"xx. {QUESTION} yy"), (2, "Yesterday Ann had 7 apples and gave 2 apples to Bob before walking 9 km home with Ann at 7 pm."),
            (3, "Yesterday Ann had 7 apples and gave 2 apples to Bob before walking 9 km home with Zoe at 8 pm."), (4, None), (None, ""), (1, f"xx. {QUESTION} yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(0))
    found = {(r.doc.doc_id, r.item_id, r.same_values) for r in templates.leaks(docs, items).collect()}
    assert found == {(1, 1, True), (2, 1, False)}
    assert Counter(r.doc_id for r in templates.without_leaks(docs, items).collect()) == Counter([3, 4, None])
    assert templates.leaks(docs.limit(0), items).collect() == templates.leaks(docs, items.limit(0)).collect() == []


def test_templates_other_names_and_values(spark):
    item = "The shop sold 40 pens on Monday. Anna bought 6 of them. How many pens are left?"
    twice = "A farmer keeps 12 hens and 12 geese in a large wooden barn behind the old stone house near the river."
    items = spark.createDataFrame([(1, item), (2, twice)], "item_id long, text string")
    texts = [item.replace("Anna", "Peter"), item.replace("Anna", "Mary Ann"), "xx " + item.replace("Anna", "Mary Ann Smith").replace("40", "55"),
             item.lower(), twice.replace("12 geese", "13 geese"), "The shop sold nothing on Monday. How many pens are left?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc.doc_id, r.item_id) for r in templates.leaks(docs, items).collect()} == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)}


def test_template_passes_make_the_same_windows(spark):
    texts = ["Anna Maria Smith met Bob in New York City on Monday and paid 12 dollars to the Old Town Hall Club there.",
             "Yes. Mary Ann Lee. Tom and Ann went home by bus", "one two three four five six seven eight", "A B C D E F G H I J K L", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (8, 5):
        full = templates._template(rows, window, "k", F.col("doc_id"))
        lean = templates._hashes(rows, window, "k", F.col("doc_id"))
        assert Counter(map(tuple, lean.collect())) == Counter(map(tuple, full.select("k", "hash").collect()))
        seen = full.collect()
        assert {(r.i, r.n) for r in seen if r.k == 2} == {(i, window) for i in range(8 - window + 1)}
        # equal tokens have equal hashes, others do not
        key = lambda r: tuple("@" if k == "^" else k or w.lower() for w, k in zip(r.core[r.i:r.i + r.n], r.kinds[r.i:r.i + r.n]))
        alone = [r for r in seen if not r.runs]
        assert len({(key(r), r.hash) for r in alone}) == len({key(r) for r in alone}) == len({r.hash for r in alone})
        assert any(r.runs and r.n > window for r in seen)
    # a word of punctuation is none, so the word behind it still opens a sentence
    odd = spark.createDataFrame([(1, "der Ball rollt. | Enno lief - Karl auch | . Tom ging heim")], "doc_id long, text string")
    first = templates._template(odd, 8, "k", F.col("doc_id")).first()
    assert list(zip(first.core, first.kinds)) == [("der", None), ("Ball", "@"), ("rollt", None), ("Enno", "^"), ("lief", None), ("Karl", "@"),
                                                  ("auch", None), ("Tom", "@"), ("ging", None), ("heim", None)]


@pytest.mark.parametrize("bound", [templates.BROADCAST_WINDOWS, 0])
def test_templates_find_every_passage(spark, documents, data, monkeypatch, bound):
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", bound)
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    found = {(r.doc.doc_id, r.item_id) for r in templates.leaks(documents, items).collect()}
    texts = [(r.item_id, r.text) for r in items.collect()]
    assert found == {(d.doc_id, i) for d in documents.collect() for i, t in texts if t in d.text}
