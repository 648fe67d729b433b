"""Post-processing of chunk metadata and context: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..values import CONTEXT_TAGS, GEO_LABEL, MAX_CONTEXT, METRICS_LABEL, YEARS_LABEL
from .text import strip, years_text


def valid_metrics(c: Column) -> Column:
    """Stripped, lower-cased metrics of 1 to 19 characters; null if none is left."""
    out = F.transform(F.filter(F.transform(c, strip), lambda x: (x != "") & ~x.rlike(r"^.{20,}$")), F.lower)
    return F.when(F.size(out) > 0, out)


def _with(context: Column, sep: str, more: Column) -> Column:
    """context + sep + more, leaving out what is empty."""
    has = F.coalesce(context, F.lit("")) != ""
    return F.when(more.isNull() | (more == ""), context).when(has, F.concat(context, F.lit(sep), more)).otherwise(more)


def heuristic_tags(context: Column, text: Column) -> Column:
    """Tags whose triggers occur in context or text, sorted, joined."""
    base = F.lower(F.concat(F.coalesce(context, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    tags = []
    for tag in sorted(CONTEXT_TAGS):
        hit = F.lit(False)
        for trigger in CONTEXT_TAGS[tag]:
            hit = hit | base.contains(trigger)
        tags.append(F.when(hit, F.lit(tag)))
    return F.concat_ws(", ", *tags)


def metadata_suffix(metrics: Column, geo: Column, years: Column) -> Column:
    def part(label: str, value: Column, of: Column) -> Column:
        return F.when(F.size(of) > 0, F.concat(F.lit(label), value))

    return F.concat_ws(
        "; ", part(METRICS_LABEL, F.concat_ws(", ", metrics), metrics), part(GEO_LABEL, F.concat_ws(", ", geo), geo), part(YEARS_LABEL, years_text(years), years)
    )


def clean_context(c: Column) -> Column:
    return F.substring(strip(F.replace(c, F.lit("\n"), F.lit(" "))), 1, MAX_CONTEXT)


def post_process(chunks: DataFrame, passes: int = 1) -> DataFrame:
    """Metrics filtered, context with tags and metadata suffix, cleaned. Once is right; a second pass repeats the suffixes."""
    for _ in range(passes):
        chunks = chunks.withColumn("metrics", valid_metrics(F.col("metrics")))
        tagged = _with(F.col("context"), " | ", heuristic_tags(F.col("context"), F.col("text")))
        chunks = chunks.withColumn("context", tagged)
        full = _with(F.col("context"), " | ", metadata_suffix(F.col("metrics"), F.col("geo"), F.col("years")))
        chunks = chunks.withColumn("context", clean_context(full))
    return chunks
