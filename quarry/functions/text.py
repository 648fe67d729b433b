"""Token, id and text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..values import ID_PREFIXES, ID_SPACES, TOKENS

Lemmas = Callable[[Column], Column]


def strip(c: Column) -> Column:
    """Without white space (any Unicode space) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(text: Column, profile: str = "cyrillic", lemmas: Lemmas | None = None) -> Column:
    """Lower-cased tokens: words (as lemmas, if given; null lemmas fall out), then all numbers, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKENS[profile]), F.lit(0))
    number = lambda t: t.rlike(r"^\d+$")
    words = F.filter(found, lambda t: ~number(t))
    if lemmas is not None:
        words = F.filter(F.transform(words, lemmas), lambda t: t.isNotNull())
    return F.concat(words, F.filter(found, number))


def bag(text: Column, profile: str = "cyrillic", lemmas: Lemmas | None = None) -> Column:
    """The same tokens in any order, for counting: one pass of the pattern."""
    if lemmas is not None:
        return tokens(text, profile, lemmas)
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKENS[profile]), F.lit(0))


def normalise(text: Column, profile: str = "cyrillic", lemmas: Lemmas | None = None) -> Column:
    return F.array_join(tokens(text, profile, lemmas), " ")


def dictionary_lemmas(mapping: dict[str, str]) -> Lemmas:
    """Lemmas from a dictionary of bounded size; words that it lacks stay."""
    table = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv]) if mapping else None
    return (lambda t: F.coalesce(F.try_element_at(table, t), t)) if mapping else (lambda t: t)


def years_text(years: Column) -> Column:
    """``first-last``; one entry alone stands for itself; null without entries."""
    span = F.concat_ws("-", F.array_min(years).cast("string"), F.array_max(years).cast("string"))
    return F.when(F.size(years) > 1, span).when(F.size(years) == 1, F.get(years, F.lit(0)).cast("string"))


def hints(metrics: Column, geo: Column, years: Column) -> Column:
    """Text of the third lexical field: three metrics, the territories, the span of years."""
    return F.concat_ws(" ", F.slice(metrics, 1, 3), geo, years_text(years))


def query_terms(query: Column, geo: Column, metrics: Column, profile: str = "cyrillic", lemmas: Lemmas | None = None) -> Column:
    """Tokens of the query, its territories and metrics; repeats count, years are not searched."""
    more = [bag(F.concat_ws(" ", c), profile, lemmas) for c in (geo, metrics)]
    return F.concat(bag(query, profile, lemmas), *more)


def normalise_id(c: Column) -> Column:
    out = strip(F.coalesce(c, F.lit("")))
    for p in ID_PREFIXES:
        out = F.when(out.startswith(p), strip(F.substring(out, F.lit(len(p) + 1), F.length(out)))).otherwise(out)
    return squeeze(F.translate(out, ID_SPACES, " " * len(ID_SPACES)))


def stable_id(c: Column) -> Column:
    """The first 8 bytes of the MD5 as a signed big-endian number."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 16), 16, -10).cast("long")


def chunk_id(source: Column, page: Column, n: Column) -> Column:
    return F.concat(source, F.lit("::page"), page.cast("string"), F.lit("::chunk"), n.cast("string"))
