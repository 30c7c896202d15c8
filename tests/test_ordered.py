"""Block scans and row rebuilding against plain Python on a small fixture, with one hot group and tiny blocks."""

import random

from pyspark.sql import functions as F

from ledgerlift.operators import ordered, usage
from ledgerlift.operators.continuity import rebuild_rows
from ledgerlift.operators.ordered import BLOCK_NO, in_blocks, neighbours, scan
from ledgerlift.sources.lines import document_lines


def test_scan_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 90), ("cold", 7), ("one", 1)):
        rows += [(key, p, rng.choice([None, None, rng.randint(1, 9)])) for p in sorted(rng.sample(range(1000), n))]
    df = spark.createDataFrame(rows, "k string, p long, m int")
    got = {(r.k, r.p): r for r in scan(df, ["k"], "p", fill={"f": "m"}, next_fill={"nf": "m"}, fill_before={"fb": "m"}, sums={"s": F.lit(1)},
                                       lags={"l": "p"}, leads={"d": "p"}, parts=7).collect()}
    for key in ("hot", "cold", "one"):
        mine = [r for r in rows if r[0] == key]
        for i, (_, p, m) in enumerate(mine):
            r = got[(key, p)]
            last = [x[2] for x in mine[:i + 1] if x[2] is not None]
            before = [x[2] for x in mine[:i] if x[2] is not None]
            nxt = [x[2] for x in mine[i:] if x[2] is not None]
            assert r.f == (last[-1] if last else None) and r.fb == (before[-1] if before else None)
            assert r.nf == (nxt[0] if nxt else None) and r.s == i + 1
            assert r.l == (mine[i - 1][1] if i else None) and r.d == (mine[i + 1][1] if i + 1 < len(mine) else None)


def test_neighbours_cross_block_edges(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("p"))
    got = neighbours(df, ["k"], "p", 2, lambda w: {"n2": F.lead("p", 2).over(w), "b1": F.lag("p").over(w)}, block=8).collect()
    assert len(got) == 50
    for r in got:
        assert r.n2 == (r.p + 2 if r.p + 2 < 50 else None) and r.b1 == (r.p - 1 if r.p else None)


def test_neighbours_over_gaps(spark):
    places = [0, 1, 2, 3, 12, 13, 90, 91, 92, 400]
    df = spark.createDataFrame([("a", p) for p in places], "k string, p long")
    got = {r.p: r.n1 for r in neighbours(df, ["k"], "p", 1, lambda w: {"n1": F.lead("p").over(w)}, block=4).collect()}
    assert got == dict(zip(places, [*places[1:], None]))


def test_nested_scans_read_their_input_once(spark):
    df = spark.range(100).select(F.lit("hot").alias("k"), (F.col("id") * 1_000_003).alias("p"))
    for n in range(4):
        df = scan(df, ["k"], "p", sums={f"s{n}": F.lit(1)})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2 and [r.s3 for r in df.orderBy("p").collect()] == list(range(1, 101))


def _rebuild(lines):
    out, i = [], 0
    while i < len(lines):
        cur = lines[i].strip()
        if not cur:
            i += 1
            continue
        n, j, text = len(cur.split()), 1, cur
        while n >= 4 and j <= 3 and i + j < len(lines):
            nxt = lines[i + j].split()
            if nxt and not (2 <= len(nxt) < n and any(w.replace(".", "").isdigit() for w in nxt[:2])):
                break
            text += (" " + " ".join(nxt)) if nxt else ""
            j += 1
        out.append(text)
        i += j
    return out


def test_rebuild_rows_matches_brute_force(spark):
    rng = random.Random(11)
    docs = []
    for d in range(12):
        lines = [" ".join(rng.choice(["a", "b", "7", "4.5"]) for _ in range(rng.randint(0, 7))) for _ in range(60)]
        docs.append((str(d), "\n".join(lines)))
    got = rebuild_rows(document_lines(spark.createDataFrame(docs, "doc_id string, text string"))).collect()
    for d, text in docs:
        mine = [r.text for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.line_no)]
        assert mine == _rebuild(text.split("\n"))


def test_admission_rounds_equal_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for key in ("a", "b", "c"):
        credits = rng.randint(5, 60)
        left = credits
        for i in range(40):
            need = rng.randint(1, 6)
            charge = 0 if rng.random() < 0.1 else need
            rows.append((key, i + 1000 * ord(key), i, need, charge, credits))
            ok = left >= need
            left -= charge if ok else 0
            want[i + 1000 * ord(key)] = ok
    df = spark.createDataFrame(rows, "api_key string, log_id long, sec int, need long, charge long, credits long") \
        .withColumn("created_at", F.timestamp_seconds(F.col("sec") * 40).cast("timestamp"))
    for limit in (1000, 5):
        assert {r.log_id: r.accepted for r in usage.admit(df, fold_limit=limit).collect()} == want


def test_scan_over_given_blocks_writes_once(spark, monkeypatch):
    """Rows that lie in blocks need no partitioning of their own, also when some of them are left out; results are those of a plain scan."""
    rng = random.Random(4)
    rows = [(k, p, rng.choice([None, rng.randint(1, 9)])) for k, n in (("hot", 120), ("cold", 5), (None, 3)) for p in rng.sample(range(1000), n)]
    df = spark.createDataFrame(rows, "k string, p long, m int")
    cut = in_blocks(df, ["k"], "p", parts=7).localCheckpoint()
    assert cut.select(BLOCK_NO).distinct().count() > 3
    new = dict(fill={"f": "m"}, next_fill={"nf": "m"}, sums={"s": F.lit(1)}, lags={"l": "p"})
    for some in ("p >= 0", "p % 3 > 0"):
        want = sorted(map(str, scan(df.where(some), ["k"], "p", parts=5, **new).collect()))
        names = []
        with monkeypatch.context() as m:
            m.setattr(ordered, "staged", lambda d, name: names.append(name) or d.localCheckpoint())
            got = scan(cut.where(some), ["k"], "p", blocks=BLOCK_NO, keep=["p", "m"], **new)
        assert names == ["scan"] and sorted(map(str, got.collect())) == want
