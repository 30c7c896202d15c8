"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and are lower-cased; numbers, units and capitalised words become typed placeholders whose values are kept
as slots. A word that opens a sentence may be a name, so it is a placeholder like one. A run of capitalised words also counts as one
placeholder, so a name may have more words in the document than in the item ('Mary Ann' for 'Bob'). Windows of `window` tokens of the
benchmark items meet the documents' windows in a hash join; for documents in lower case the items' windows are also made with openers, or
all words, in lower case. Windows of one document and item that lie on one diagonal, or within NEAR words of it, are put together; the
pair is a leak if they cover half of the item and at least `least` of its words (all, if it has fewer), and if the slots agree in most
windows (equal values of the item have equal values in the document and the other way round), or if windows with the item's own
values alone cover as much. So a question with other numbers or names is caught, and chance hits of placeholders are not.

A first pass joins hashes alone; windows with their words and slots are made of the documents that it finds. The benchmark's windows, and
the keys of these documents, are broadcast only when their counted number is at most BROADCAST_WINDOWS; beyond it the join is shuffled.
Only DataFrame functions.

Null or empty texts have no windows. Items that differ in nothing but their id count once, under the least id; items shorter than `window`
words cannot be found. Windows that are mostly placeholders, openers left aside, do not count. A document is doc_id and text, so repeated rows give one
result and null ids do not mix. Further columns pass through `without_leaks`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlift.llm.common import keep, words

WINDOW = 8
LEAST = 13
NEAR = 8  # diagonals so many words apart count together
NAME, OPENER = "@", "^"  # kinds of capitalised words; both are one placeholder
CUT = "~"
BROADCAST_WINDOWS = 2_000_000  # rows of 16 bytes and their slots
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡·"  # what is cut from the ends of words
UNITS = ("mm cm m km ml l g kg mg lb lbs oz inch inches foot feet yard yards mile miles meter meters metre metres liter liters litre "
         "litres gram grams kilogram kilograms second seconds minute minutes hour hours day days week weeks month months year years percent "
         "dollar dollars euro euros cent cents usd eur kmh mph").split()


def _doc() -> Column:
    return F.struct("doc_id", F.xxhash64("doc_id", "text").alias("text_hash"))


def _doubled(rows: DataFrame, tokens: str, window: int) -> DataFrame:
    """rows with `wide`: hashes of the windows of an array, by place, made of pairs, pairs of pairs and so on, so that a window of eight
    takes three steps. A width that is no power of two overlaps its last parts. The last window - 1 entries are no whole windows."""
    rows, width = rows.withColumn("wide", F.col(tokens)), 1
    while width < window:
        far = min(width, window - width)
        # a column of its own per step: read twice in the next one, it is made once
        rows = rows.withColumn("wide", F.zip_with("wide", F.slice("wide", F.lit(far + 1), F.size("wide")), lambda x, y: F.xxhash64(x, y)))
        width += far
    return rows


def _tokens(rows: DataFrame, window: int, name: str, value: Column, opener: str | None = OPENER) -> DataFrame:
    """For each row: the value under its name, its arrays core and kinds, heads (words that do not go on with a run of names, and the end)
    and the hashes of its windows: plain ones by first word, joint ones (a run is one token) by first head."""
    both = rows.select(value.alias(name), words(F.col("text")).alias("raw")).withColumn("bare", F.transform("raw", lambda w: F.btrim(w, F.lit(OUTER))))
    core = both.select(name, F.filter("bare", lambda w: w != "").alias("core"), F.filter("raw", lambda w, i: F.get("bare", i) != "").alias("raw"))
    core = core.withColumn("before", F.slice(F.concat(F.array(F.lit(".")), "raw"), F.lit(1), F.size("raw")))

    def kind(w: Column, before: Column) -> Column:
        first = F.substring(w, 1, 1)
        return (F.when((first >= "0") & (first <= "9"), F.lit("#"))
                .when(first != F.lower(first), F.when(before.rlike(r"[.!?:]\W*$"), F.lit(opener)).otherwise(F.lit(NAME)))
                .when(F.lower(w).isin(UNITS), F.lit("%")))

    kinds = core.select(name, "core", F.zip_with("core", "before", kind).alias("kinds"))
    listed = kinds.withColumn("t", F.zip_with("core", "kinds", lambda w, k: F.xxhash64(
        F.when(k == OPENER, F.lit(NAME)).otherwise(F.coalesce(k, F.lower(w))))))
    n = F.size("t")
    heads = F.filter(F.transform("kinds", lambda k, p: F.when(~(_goes_on(k, F.get("kinds", p - 1))), p)), lambda p: p.isNotNull())
    listed = _doubled(listed.withColumn("heads", F.concat(heads, F.array(n))), "t", window).withColumnRenamed("wide", "plain")
    runs = F.when((F.size("heads") <= n) & (F.size("heads") > window), F.transform("heads", lambda h: F.get("t", h)))
    listed = _doubled(listed.withColumn("runs", F.coalesce(runs, F.array().cast("array<bigint>"))), "runs", window).withColumnRenamed("wide", "joint")
    return listed.select(name, "core", "kinds", "heads", F.slice("plain", F.lit(1), F.greatest(n - (window - 1), F.lit(0))).alias("plain"), "joint")


def _holds_run(p: Column, window: int) -> Column:
    """Whether the window of heads from p on holds a run; null, so no, where it is cut by the end."""
    return F.get("heads", p + window) - F.get("heads", p) > window


def _hashes(rows: DataFrame, window: int, name: str, value: Column) -> DataFrame:
    """The value under its name and the hash, for each window that _template makes. No array goes with them."""
    made = _tokens(rows, window, name, value)
    return made.select(name, F.explode(F.concat("plain", F.filter("joint", lambda h, p: _holds_run(p, window)))).alias("hash"))


def _template(rows: DataFrame, window: int, name: str, value: Column, opener: str | None = OPENER) -> DataFrame:
    """For each window of each row: the value under its name, first word i, number of words and hash, whether runs are one placeholder
    in it, and the row's arrays core and kinds, which every window carries. Openers are of kind `opener`; without one they stay words."""
    made = _tokens(rows, window, name, value, opener)
    plain = F.transform("plain", lambda h, i: F.struct(i.alias("i"), F.lit(window).alias("n"), h.alias("hash"), F.lit(False).alias("runs")))
    joint = F.filter(F.transform("joint", lambda h, p: F.when(_holds_run(p, window), F.struct(
        F.get("heads", p).alias("i"), (F.get("heads", p + window) - F.get("heads", p)).alias("n"), h.alias("hash"), F.lit(True).alias("runs")))),
        lambda w: w.isNotNull())
    # exploded as an expression: of a column Spark would infer a filter and make the arrays again below
    return made.select(name, "core", "kinds", F.explode(F.concat(plain, joint)).alias("at")).select(name, "core", "kinds", "at.*")


def _goes_on(kind: Column, before: Column) -> Column:
    """Whether a name goes on with the run of capitalised words before it."""
    return F.coalesce((kind == NAME) & before.isin(NAME, OPENER), F.lit(False))


def _slots() -> Column:
    """Kind and value of each placeholder in the window at i; a run is one value where it is one placeholder. The value has CUT before it
    at an end of the window that cuts a run."""
    at, n = F.col("i") + 1, F.col("n")
    kinds, core = F.slice("kinds", at, n), F.slice("core", at, n)
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), kinds), F.lit(1), n)
    kind_at = lambda i: F.get("kinds", i)
    head, tail = _goes_on(kind_at(at - 1), kind_at(at - 2)), _goes_on(kind_at(at + n - 1), kind_at(at + n - 2))

    def part(e: Column, q: Column) -> Column:
        mark = F.when(e["k"] == OPENER, F.lit(NAME)).otherwise(e["k"])
        cut = F.when(((q == 0) & head) | ((q == n - 1) & tail), F.lit(CUT)).otherwise("")
        joint = F.when(F.col("runs") & _goes_on(e["k"], e["b"]), F.lit("_")).otherwise(F.concat(F.lit(" "), mark, cut))
        return F.when(e["k"].isNotNull(), F.concat(joint, F.lower(e["w"])))
    return F.filter(F.split(F.array_join(F.transform(F.arrays_zip(kinds.alias("k"), core.alias("w"), before.alias("b")), part), ""), " "), lambda s: s != "")


def _asked(benchmark: DataFrame, window: int) -> DataFrame:
    """The items' windows: as they are, and with openers or all words in lower case for documents that write them so."""
    items = benchmark.groupBy("text").agg(F.min("item_id").alias("item_id"))
    found = []
    for rows, opener in ((items, OPENER), (items, None), (items.withColumn("text", F.lower("text")), None)):
        made = _template(rows, window, "item_id", F.col("item_id"), opener).withColumn("item_slots", _slots())
        openers = F.size(F.filter(F.slice("kinds", F.col("i") + 1, F.col("n")), lambda k: k == OPENER))
        found.append(made.filter(2 * (F.size("item_slots") - openers) <= window).select(
            "item_id", F.size("core").alias("tokens"), F.col("i").alias("j"), F.col("n").alias("m"), "hash", "item_slots"))
    return reduce(DataFrame.union, found).distinct()


def _covered(wins: Column) -> Column:
    """Words of the item under any of the windows."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    step = lambda a, w: F.struct(F.greatest(a["end"], w["j"] + w["m"]).alias("end"),
                                 (a["sum"] + F.greatest(F.lit(0), w["j"] + w["m"] - F.greatest(a["end"], w["j"]))).alias("sum"))
    return F.aggregate(F.array_sort(wins), zero, step, lambda a: a["sum"])


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """One row per leaked document and item: doc (key), item_id, n_tokens of the item, n_covered, n_slots, same_values."""
    asked = keep(_asked(benchmark, window), "item-windows")
    few = asked.count() <= BROADCAST_WINDOWS
    hashes = asked.select("hash").distinct()
    # which documents hold any of the windows: found by hashes alone, so that only these make rows with their words
    held = keep(_hashes(docs, window, "doc", _doc()).join(F.broadcast(hashes) if few else hashes, "hash", "left_semi").select("doc").distinct(), "held")
    held = held.withColumnRenamed("doc", "held_doc")
    docs = docs.select("doc_id", "text").join(F.broadcast(held) if held.count() <= BROADCAST_WINDOWS else held, _doc() == F.col("held_doc"), "left_semi")
    seen = _template(docs, window, "doc", _doc())
    if few:  # slots are then made for the hits only
        hits = seen.join(F.broadcast(asked), "hash").withColumn("slots", _slots())
    else:
        hits = seen.select("doc", "i", "hash", _slots().alias("slots")).join(asked, "hash")
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    key = ["doc", "item_id", "tokens"]
    on_line = hits.groupBy(*key, (F.col("i") - F.col("j")).alias("shift")).agg(F.collect_set(F.struct("j", "m", pairs.alias("pairs"))).alias("own"))
    near = F.array_distinct(F.flatten(F.collect_list("own").over(W.partitionBy(*key).orderBy("shift").rangeBetween(-NEAR, NEAR))))
    # a diagonal may pass alone, or with those beside it
    sets = on_line.withColumn("near", near).select(*key, F.explode(F.array("own", "near")).alias("wins"))
    enough = lambda n: (2 * n >= F.col("tokens")) & (n >= F.least(F.lit(least), "tokens"))
    differ = lambda p: F.translate(p["item"], CUT, "") != F.translate(p["doc"], CUT, "")
    cut = lambda p: (F.substring(p["item"], 2, 1) == CUT) | (F.substring(p["doc"], 2, 1) == CUT)
    sets = sets.withColumn("covered", _covered(F.col("wins"))).filter(enough(F.col("covered")))
    sets = sets.withColumn("pairs", F.array_distinct(F.flatten(F.col("wins.pairs"))))
    clash = F.filter("pairs", lambda p: ~cut(p) & F.exists("pairs", lambda q: ~cut(q) & ((p["item"] == q["item"]) != (p["doc"] == q["doc"]))))
    sets = sets.withColumn("clash", clash).withColumn("verbatim", _covered(F.filter("wins", lambda w: ~F.exists(w["pairs"], differ))))
    agree = 2 * F.size(F.filter("wins", lambda w: ~F.arrays_overlap(w["pairs"], F.col("clash")))) > F.size("wins")
    found = sets.filter(agree | enough(F.col("verbatim"))).withColumn("same", ~F.exists("pairs", differ))
    best = F.max(F.struct(F.col("covered"), F.col("same"), F.size("pairs").alias("n_slots")))
    return found.groupBy(*key).agg(best.alias("b")).select(
        "doc", "item_id", F.col("tokens").cast("long").alias("n_tokens"), F.col("b.covered").cast("long").alias("n_covered"),
        F.col("b.n_slots").cast("long").alias("n_slots"), F.col("b.same").alias("same_values"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    leaked = leaks(docs, benchmark).select(F.col("doc").alias("leaked_doc")).distinct()
    return docs.join(leaked, _doc() == F.col("leaked_doc"), "left_anti")
