"""Which pages hold data: one CASE expression, evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..values import NO_TEXT, SKIP_KEYWORDS, SKIP_PATTERNS

DATA, METADATA, SKIP = "data", "metadata", "skip"


def bilingual_heading(text: Column) -> Column:
    """First line with a Cyrillic letter, second in Latin capitals of at most five words."""
    lines = F.split(F.substring(text, 1, 200), "\n")
    first, second = strip(F.get(lines, F.lit(0))), strip(F.get(lines, F.lit(1)))
    capitals = second.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$") & second.rlike("[A-Z]")
    few = F.size(F.split(second, r"(?U)\s+")) <= 5
    return F.coalesce(first.rlike(r"[Ѐ-ӿ]") & capitals & few, F.lit(False))


def chunk_type(page: Column, text: Column, skip_first_pages: int = 5) -> Column:
    head = F.substring(text, 1, 200)
    pattern = F.lit(False)
    for p in SKIP_PATTERNS:
        pattern = pattern | head.rlike(f"(?iu){p}")
    words = F.slice(F.split(F.lower(strip(text)), r"(?U)\s+"), 1, 5)
    keyword = F.arrays_overlap(words, F.array(*[F.lit(k) for k in SKIP_KEYWORDS]))
    return (
        F.when(page <= skip_first_pages, METADATA)
        .when(F.coalesce(strip(text), F.lit("")) == "", SKIP)
        .when(pattern, METADATA)
        .when(keyword, METADATA)
        .when(bilingual_heading(text), METADATA)
        .otherwise(DATA)
    )


def classify(chunks: DataFrame, skip_first_pages: int = 5) -> DataFrame:
    return chunks.withColumn("chunk_type", chunk_type(F.col("page"), F.col("text"), skip_first_pages))


def split_by_type(chunks: DataFrame, skip_first_pages: int = 5) -> dict[str, DataFrame]:
    typed = classify(chunks, skip_first_pages)
    return {t: typed.where(F.col("chunk_type") == t) for t in (DATA, METADATA, SKIP)}


def default_context(text: Column, n: int = 200) -> Column:
    return F.coalesce(F.nullif(F.substring(text, 1, n), F.lit("")), F.lit(NO_TEXT))
