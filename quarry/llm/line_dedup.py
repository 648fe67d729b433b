"""Cross-site boilerplate lines by distinct-site spread.

Every non-blank line (trimmed) is hashed, and a HyperLogLog sketch of the sites it occurs on
is kept per line hash; sketches of the same line merge by aggregation. A line whose
estimate lies clearly above ``min_sites`` is boilerplate and one clearly below is not; lines
within the sketch's error of the threshold get an exact distinct count. Boilerplate is
removed wherever it occurs except at its first place (smallest document, then line),
so that text which is repeated as a whole is kept once.

Lines are 64-bit hashes in a table of the shared folder; texts are shuffled once, when a
document meets the numbers of its removed lines. A hot line is aggregated before shuffling
(sketch, exact count) and its join side is split by Spark where it is skewed.

Defined cases: null text stays null and has no lines; blank lines are never removed; a null
source is no site; equal rows are changed in the same way; a null id is an id like any
other; an empty table gives no rows; other columns are kept as they are, but columns named like the two
counts give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialise

LG_K = 12
ERROR = 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("?")), F.col(text_col))


def line_table(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """(id, k, pos, site, line): k tells rows apart, line is the trimmed line's hash."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("k"), F.xxhash64(site_col).alias("h"), F.col(site_col).isNotNull().alias("named"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(" \t\r\f\u000b"))
    return rows.select("id", "k", "pos", F.when(F.col("named"), F.col("h")).alias("site"), trimmed.alias("line")).where("line <> ''").withColumn("line", F.xxhash64("line"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, first): the lines on at least ``min_sites`` sites, and their first place."""
    band = max(1.0, 4 * ERROR * min_sites)
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("id", "k", "pos")).alias("first"))
    spread = materialise(spread.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - band), "line-spread")
    near = spread.where(F.col("sites") <= min_sites + band).select("line")
    exact = lines.join(near, "line", "left_semi").where("site is not null").groupBy("line", "site").count().groupBy("line").agg(F.count("*").alias("exact"))
    sure = spread.where(F.col("sites") > min_sites + band).select("line", "first")
    return sure.unionByName(spread.join(exact.where(F.col("exact") >= min_sites).select("line"), "line", "left_semi").select("line", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines taken out of ``text``, and n_lines and n_removed."""
    lines = materialise(line_table(docs, id_col, site_col, text_col), "lines")
    boiler = boilerplate(lines, min_sites)
    here = F.struct("id", "k", "pos")
    removed = lines.join(boiler, "line").where(~here.eqNullSafe(F.col("first"))).groupBy(F.col("k").alias("__k")).agg(F.collect_set("pos").alias("__removed"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).alias("__text"), _row_key(id_col, text_col).alias("__k"))
    own = own.join(removed, "__k", "left").withColumn("__lines", F.when(F.col("__removed").isNotNull(), _lines(F.col("__text"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__removed", F.array().cast("array<int>")))
    text = F.when(F.col("__removed").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    n = F.when(F.col("__text").isNull(), 0).otherwise(F.length("__text") - F.length(F.replace(F.col("__text"), F.lit("\n"), F.lit(""))) + 1)
    return own.select(
        *[(text if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)], n.cast("long").alias("n_lines"), F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed")
    )
