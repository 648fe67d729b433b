"""Spelling correction against a dictionary of words with frequencies.

A token that the dictionary holds stays; else the most frequent word at one edit, else at two (a swap of neighbours is one edit). Candidates
share a deletion variant with the token, so the join is on equal keys; distances are then checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .index import best

DISTANCE = 2


def deletions(word: Column, n: int = DISTANCE) -> Column:
    """The word and what is left of it without up to n characters."""
    out = F.array(word)
    for _ in range(n):
        less = F.flatten(F.transform(out, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))))
        out = F.array_distinct(F.concat(out, less))
    return out


def swaps(word: Column) -> Column:
    """The word with each pair of neighbours swapped."""
    at = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word)))
    return F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), at)).otherwise(F.array().cast("array<string>"))


def edits(a: Column, b: Column) -> Column:
    """How many edits (insert, delete, replace, swap neighbours), made one after another, turn a into b: 0, 1 or 2, null if more.
    A swap costs two plain edits, so only pairs within four of those are looked at closer."""
    plain = F.levenshtein(a, b, 2 * DISTANCE)
    near = lambda x, y: F.levenshtein(x, y, 1) >= 0
    through = F.exists(swaps(a), lambda s: near(s, b)) | F.exists(swaps(b), lambda s: near(a, s)) | F.arrays_overlap(swaps(a), swaps(b))
    return F.when(plain < 0, None).when(plain < 2, plain).when(plain == 2, F.when(F.array_contains(swaps(a), b), 1).otherwise(2)).when(through, 2)


def corrections(words: DataFrame, dictionary: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    """words (word), dictionary (word, freq) -> (word, correction); ties go to the alphabetically first. ``custom`` words count as
    words seen once more: they stay as they are and may be corrections."""
    asked = words.select("word").where("word is not null").distinct()
    known = dictionary.select("word", "freq")
    if custom:
        more = dictionary.sparkSession.createDataFrame([(w, 1) for w in dict.fromkeys(custom)], "word string, freq long")
        known = known.unionByName(more).groupBy("word").agg(F.sum("freq").alias("freq"))
    lost = materialise(asked.join(known, "word", "left_anti"), "misspelt")
    size = F.length("word")
    sizes = lost.select(F.explode(F.sequence(size - DISTANCE, size + DISTANCE)).alias("size")).distinct()
    close = materialise(known.join(F.broadcast(sizes), size == F.col("size"), "left_semi"), "candidates")  # others are further away
    keys = lambda df: df.select("*", F.explode(deletions(F.col("word"))).alias("key"))
    pairs = keys(lost).join(keys(close).select(F.col("word").alias("candidate"), "freq", "key"), "key").select("word", "candidate", "freq").distinct()
    near = pairs.withColumn("d", edits(F.col("word"), F.col("candidate"))).where("d is not null")
    found = best(near, 1, ["word"], F.asc("d"), F.desc("freq"), F.asc("candidate")).select("word", "candidate")
    return asked.join(found, "word", "left").select("word", F.coalesce("candidate", "word").alias("correction"))


def correct_queries(queries: DataFrame, dictionary: DataFrame, custom: tuple[str, ...] = (), id_col: str = "query_id", col: str = "query") -> DataFrame:
    """``queries`` with each white-space token of ``col`` corrected, joined by single spaces."""
    toks = queries.select(id_col, F.posexplode(F.filter(F.split(F.coalesce(col, F.lit("")), r"(?U)\s+"), lambda t: t != "")).alias("i", "word"))
    fixed = toks.join(corrections(toks, dictionary, custom), "word").groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "correction"))), lambda x: x["correction"]), " ").alias("__fixed"))
    return queries.join(fixed, id_col, "left").withColumn(col, F.coalesce("__fixed", F.lit(""))).drop("__fixed")
