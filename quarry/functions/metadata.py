"""Metadata agreement of a chunk and a query, each part between 0 and 1.

The chunk's and the query's territories and metrics come as token arrays, made once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..values import METADATA_WEIGHTS


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def geo_score(chunk: Column, query: Column) -> Column:
    """Share of the query's distinct tokens; without tokens on a side 0."""
    q = F.array_distinct(query)
    return F.when(_some(chunk) & _some(query), F.size(F.array_intersect(chunk, q)) / F.size(q)).otherwise(0.0)


def metrics_score(chunk: Column, query: Column) -> Column:
    return F.when(_some(chunk) & _some(query), F.size(F.array_intersect(chunk, query)) / F.size(F.array_union(chunk, query))).otherwise(0.0)


def years_score(chunk: Column, query: Column) -> Column:
    q = F.array_distinct(query)
    common = F.size(F.array_intersect(chunk, q))
    apart = (F.array_max(chunk) < F.array_min(query)) | (F.array_max(query) < F.array_min(chunk))
    return F.when(~_some(chunk) | ~_some(query), 0.0).when(common > 0, common / F.size(q)).when(apart, 0.0).otherwise(0.3)


def granularity_score(chunk: Column, query: Column) -> Column:
    return F.coalesce((chunk == query).cast("double"), F.lit(0.0))


def oked_score(chunk: Column, query: Column) -> Column:
    c, q = F.lower(F.trim(chunk)), F.lower(F.trim(query))
    return F.when((c == "") | (q == "") | c.isNull() | q.isNull(), 0.0).when(c == q, 1.0).when(c.startswith(q) | q.startswith(c), 0.7).otherwise(0.0)


def total_score(parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in METADATA_WEIGHTS.items():
        total = total + F.lit(weight) * parts[name]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def parts(prefix_chunk: str = "", prefix_query: str = "q_") -> dict[str, Column]:
    """Parts over columns geo_tokens, metric_tokens, years, time_granularity, oked of both sides."""
    c, q = (lambda n: F.col(prefix_chunk + n)), (lambda n: F.col(prefix_query + n))
    return {
        "geo": geo_score(c("geo_tokens"), q("geo_tokens")),
        "metrics": metrics_score(c("metric_tokens"), q("metric_tokens")),
        "years": years_score(c("years"), q("years")),
        "granularity": granularity_score(c("time_granularity"), q("time_granularity")),
        "oked": oked_score(c("oked"), q("oked")),
    }
