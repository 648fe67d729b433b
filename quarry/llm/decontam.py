"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Words are hashed, ``k`` consecutive word hashes make a k-gram hash, and of every ``w`` =
``span`` - k + 1 consecutive k-grams the rightmost smallest one is a fingerprint. Any
``span`` equal words select the same fingerprint at the same place on both sides, so no
shared span of that length is missed. Fingerprints of documents and items are joined, and a
hit is extended to every window of ``span`` words around it that is equal word for
word (64-bit hash for hash). An item of fewer words than ``span`` is one window; its whole
hash is looked up at each position of a document, for each such length that occurs.

A document's fingerprints are made and joined in the pass that reads it, with the
items' fingerprints broadcast as long as they number at most ``broadcast_rows`` (each row
is about 200 bytes); beyond that the join shuffles rows of two dozen numbers. One marker row
for each document goes the same way, so the rows grouped by document at the end are the
markers and the hits, not the texts.

Defined cases: null text has no words; items without words or without an id take no part,
and rows of one item_id are one item; each document row gives one row, also where ids or whole rows repeat; an empty benchmark hits nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialise

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, NOT_WORD), "")


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def _selected(k: int, w: int) -> Column:
    """Whether the k-gram at ``p`` is the rightmost smallest of some window of w k-grams:
    enough larger (to the left: or equal) neighbours without a gap."""
    here = _at("grams", F.col("p"))

    def reach(step: int, beats) -> Column:
        out = F.lit(w - 1)
        for d in range(w - 1, 0, -1):
            i = F.col("p") + step * d
            inside = (i >= 0) & (i <= F.col("n_words") - k)
            out = F.when(inside & beats(_at("grams", i)), out).otherwise(d - 1)
        return out

    return reach(-1, lambda x: x >= here) + reach(1, lambda x: x > here) + 1 >= w


def fingerprints(rows: DataFrame, span: int, short: list[int], marker: bool) -> DataFrame:
    """``rows`` has n_words and hashes besides its own columns; adds kind (0: winnowed, else a
    short length), p, fp and near (the hashes around p that windows over it touch)."""
    k = span // 2
    w = span - k + 1
    own = [c for c in rows.columns if c != "hashes"]
    grams = rows
    if k == 4:  # by doubling: two hashes an element instead of four look-ups
        grams = grams.withColumn("pairs", F.transform("hashes", lambda x, i: F.xxhash64(x, _at("hashes", i + 1))))
        grams = grams.withColumn("grams", F.transform("pairs", lambda x, i: F.xxhash64(x, _at("pairs", i + 2))))
    else:
        grams = grams.withColumn("grams", F.transform("hashes", lambda x, i: F.xxhash64(*[_at("hashes", i + j) for j in range(k)])))
    last = F.greatest(F.col("n_words") - k, F.lit(-1))
    first = F.lit(-1 if marker else 0)
    places = F.sequence(first, last) if marker else F.when(last >= 0, F.sequence(first, last))
    lo = F.greatest(F.col("p") - (w - 1), F.lit(0))
    near = F.slice("hashes", lo + 1, F.col("p") + span - lo)
    found = (
        grams.select(*own, "hashes", "grams", F.explode(places).alias("p"))
        .where((F.col("p") < 0) | _selected(k, w))
        .select(*own, F.lit(0).alias("kind"), "p", F.when(F.col("p") >= 0, _at("grams", F.col("p"))).alias("fp"), near.alias("near"))
    )
    for m in short:
        whole = F.xxhash64(F.slice("hashes", F.col("p") + 1, m))
        found = found.unionByName(
            rows.where(F.col("n_words") >= m)
            .select(*own, "hashes", F.explode(F.sequence(F.lit(0), F.col("n_words") - m)).alias("p"))
            .select(*own, F.lit(m).alias("kind"), "p", whole.alias("fp"), F.slice("hashes", F.col("p") + 1, m).alias("near"))
        )
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 8, min_items: int = 2, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per distinct document (id and text): doc_id, text_hash, n_rows, n_words, n_hit (words inside shared windows), items
    (sorted ids as text), windows (start, length), contaminated (at least ``min_items`` items)."""
    k = span // 2

    def hashed(text: Column) -> Column:
        return F.transform(words(text), lambda x: F.xxhash64(x))

    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), hashed(F.col(item_text_col)).alias("hashes"))
    items = items.withColumn("n_words", F.size("hashes")).where("n_words > 0")
    short = sorted(r[0] for r in items.where(F.col("n_words") < span).select("n_words").distinct().collect())  # span - 1 numbers at most
    tests = fingerprints(items.where(F.col("n_words") >= span), span, [], False)
    for m in short:
        tests = tests.unionByName(items.where(F.col("n_words") == m).select("item_id", "n_words", F.lit(m).alias("kind"), F.lit(0).alias("p"), F.xxhash64("hashes").alias("fp"), F.col("hashes").alias("near")))
    tests = tests.select("item_id", F.col("n_words").alias("n_item"), F.col("kind").alias("t_kind"), F.col("p").alias("q"), F.col("fp").alias("t_fp"), F.col("near").alias("t_near"))
    if tests.count() <= broadcast_rows:
        tests = F.broadcast(tests)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), hashed(F.col(text_col)).alias("hashes"))
    rows = rows.withColumn("n_words", F.size("hashes"))
    hits = (
        fingerprints(rows, span, short, True)
        .join(tests, (F.col("fp") == F.col("t_fp")) & (F.col("kind") == F.col("t_kind")), "left")
        .where((F.col("p") < 0) | F.col("item_id").isNotNull())
    )
    lo, t_lo = F.greatest(F.col("p") - (span - k), F.lit(0)), F.greatest(F.col("q") - (span - k), F.lit(0))

    def same(o: Column) -> Column:
        """The windows that start o words before the fingerprint lie inside both texts and are equal."""
        a, b = F.col("p") - o, F.col("q") - o
        inside = (a >= 0) & (b >= 0) & (a + span <= F.col("n_words")) & (b + span <= F.col("n_item"))
        return F.when(inside, F.slice("near", a - lo + 1, span) == F.slice("t_near", b - t_lo + 1, span)).otherwise(False)

    window = lambda start, n: F.struct(start.cast("int").alias("start"), n.cast("int").alias("n"))
    extended = F.transform(F.filter(F.sequence(F.lit(0), F.lit(span - k)), same), lambda o: window(F.col("p") - o, F.lit(span)))
    whole = F.when(F.col("near") == F.col("t_near"), F.array(window(F.col("p"), F.col("kind")))).otherwise(F.array().cast("array<struct<start:int,n:int>>"))
    found = hits.select("doc_id", "text_hash", "n_words", "item_id", (F.col("p") < 0).alias("is_row"), F.explode_outer(F.when(F.col("p") >= 0, F.when(F.col("kind") == 0, extended).otherwise(whole))).alias("window"))
    found = found.withColumn("item_id", F.when(F.col("window").isNotNull(), F.col("item_id").cast("string")))

    per_doc = found.groupBy("doc_id", "text_hash", "n_words").agg(F.count_if("is_row").alias("n_rows"), F.array_sort(F.collect_set("window")).alias("windows"), F.array_sort(F.collect_set("item_id")).alias("items"))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def cover(acc: Column, x: Column) -> Column:
        stop = x["start"] + x["n"]
        return F.struct(F.greatest(acc["upto"], stop).alias("upto"), (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["upto"], x["start"]))).alias("n"))

    n_hit = F.aggregate("windows", start, cover, lambda acc: acc["n"])
    return per_doc.select("doc_id", "text_hash", "n_rows", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), "items", "windows", (F.size("items") >= min_items).alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    found = contamination(docs, benchmark, **params)
    return found.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows")))).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that are not contaminated."""
    bad = contamination(docs, benchmark, **params).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    bad = materialise(bad, "contaminated")  # of known size from here on: a small table saves the shuffle of the texts
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    return docs.join(bad, same, "left_anti")
