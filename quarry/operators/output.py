"""What a search returns, in the shapes a caller asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MODES = ("raw", "table", "chart", "llm")


def output(results: DataFrame, mode: str = "raw") -> DataFrame:
    """raw: a line of text for each row; table: the rows. Charts and written answers are not offered."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "table":
        return results
    if mode != "raw":
        raise NotImplementedError(mode)
    return results.select("query_id", "rank", F.format_string("[%.4f] %s (p. %d): %s", "hybrid_score", "source", "page", F.coalesce("context", F.lit(""))).alias("line"))


def summary(results: DataFrame, n: int = 3) -> DataFrame:
    """The first n of each query with the metadata that is there, in one column."""
    named = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    text = F.concat_ws("; ", named("geo: ", F.concat_ws(", ", "geo")), named("metrics: ", F.concat_ws(", ", "metrics")), named("years: ", F.concat_ws(", ", F.col("years").cast("array<string>"))), named("granularity: ", F.col("time_granularity")), named("oked: ", F.col("oked")))
    return results.where(F.col("rank") <= n).select("query_id", "rank", "id", F.round("hybrid_score", 4).alias("score"), text.alias("metadata"))
