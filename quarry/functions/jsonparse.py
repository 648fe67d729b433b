"""JSON answers of a language model, as column expressions.

``try_parse_json`` differs from other parsers on odd input: repeated keys and NaN give null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..values import CYRILLIC, MAX_CONTEXT, MAX_METRICS
from .text import strip


def strip_fence(raw: Column) -> Column:
    """Without a Markdown fence: the first line from ``` on (if there is a second), and a ``` at the end."""
    s = strip(raw)
    body = F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n", ""), r"```$", "")
    return F.when(s.startswith("```"), strip(body)).otherwise(s)


def first_object(s: Column) -> Column:
    """The first balanced ``{...}``, braces counted without regard to quotes; null if none closes."""
    braces = F.regexp_extract_all(s, F.lit(r"[^{}]*[{}]"), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))

    def step(a: Column, piece: Column) -> Column:
        at = a["at"] + F.length(piece)
        opens = piece.endswith("{")
        depth = F.when(opens, a["depth"] + 1).when(a["start"].isNull(), 0).otherwise(a["depth"] - 1)
        start = F.when(a["start"].isNull() & opens, at).otherwise(a["start"])
        end = F.when(a["end"].isNull() & ~opens & a["start"].isNotNull() & (depth == 0), at).otherwise(a["end"])
        return F.struct(depth.cast("int").alias("depth"), at.cast("int").alias("at"), start.cast("int").alias("start"), end.cast("int").alias("end"))

    span = F.aggregate(braces, state, step)
    return F.when(span["end"].isNotNull(), F.substring(s, span["start"], span["end"] - span["start"] + 1))


def _object(s: Column) -> Column:
    """The text as VARIANT if it holds one JSON object and nothing else. Inside brackets, as the parser would
    otherwise ignore what follows the object."""
    many = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    v = F.try_variant_get(many, "$[0]", "variant")
    return F.when(F.schema_of_variant(v).startswith("OBJECT") & F.try_variant_get(many, "$[1]", "variant").isNull(), v)


def parse_answer(raw: Column) -> Column:
    """VARIANT object of an ingest answer: the whole text, else its first balanced object; null if neither is one."""
    s = strip_fence(raw)
    return F.coalesce(F.when(s.startswith("{"), _object(s)), _object(first_object(s)))


def parse_query_answer(raw: Column) -> Column:
    """VARIANT object from the first ``{`` to the last ``}``; null stands for no fields."""
    return _object(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))


def string_field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def strings_field(v: Column, name: str) -> Column:
    """An array of strings; a single string counts as an array of one."""
    many = F.try_variant_get(v, f"$.{name}", "array<string>")
    one = F.try_variant_get(v, f"$.{name}", "string")
    return F.coalesce(many, F.when(one.isNotNull() & ~one.startswith("[") & ~one.startswith("{"), F.array(one)))


def normalise_context(c: Column) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, MAX_CONTEXT)


def normalise_metrics(c: Column, profile: str = "cyrillic") -> Column:
    """Of the first five entries those with a Cyrillic letter (profile unicode: any letter), stripped; null if none."""
    kept = F.filter(F.slice(c, 1, MAX_METRICS), lambda x: x.rlike(CYRILLIC if profile == "cyrillic" else r"\p{L}"))
    out = F.transform(kept, strip)
    return F.when(F.size(out) > 0, out)


def normalise_years(c: Column) -> Column:
    """Entries that are whole numbers, in order; null if none."""
    whole = F.filter(F.transform(c.cast("array<string>"), lambda x: F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), x.try_cast("int"))), lambda x: x.isNotNull())
    return F.when(F.size(whole) > 0, whole)
