"""Enrichment by a language model: the model is called in Python, all else is column expressions.

Answers are written to the shared folder before they are parsed, so later stages and lost
executors do not call the model again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import EnrichConfig
from ..functions import jsonparse as js
from ..functions.postprocess import post_process
from ..providers import Generator
from ..session import materialise
from ..values import NO_TEXT
from .classify import classify, default_context

SYSTEM = (
    "You are an analyst of official statistics. From a fragment of a yearbook extract metadata for search. Answer with one JSON object: "
    "context (one sentence on what the tables show, without values), geo (list of territories), metrics (list of indicator names), "
    "years (list of years), time_granularity ('year', 'quarter', 'month' or null), oked (activity code or null). Use the language of the text."
)
QUERY_SYSTEM = (
    "From a user's question extract the structure for search. Answer with one JSON object: geo (list), metrics (list of names), "
    "years (list of whole years, ranges spelt out), time_granularity, oked. Add nothing the question does not say."
)
TEXT_CHARS, LOG_CHARS = 800, 1200


ANSWER = "key string, raw string, error string"


def _call(generator: Generator, system: str, reset_every: int, wait: float):
    """Rows (key, prompt) to ANSWER; an error becomes the name of its class."""

    def run(batches):
        import time

        import pyarrow as pa

        done = 0
        for b in batches:
            out = []
            for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                time.sleep(wait)
                try:
                    out.append((k, generator.generate(system, p), None))
                    done += 1
                    if reset_every and done % reset_every == 0:
                        generator.reset()
                except Exception as e:
                    out.append((k, None, type(e).__name__))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*out)], names=["key", "raw", "error"])

    return run


def ask(df: DataFrame, key: str, prompt, gate, generator: Generator, cfg: EnrichConfig, system: str, usable) -> DataFrame:
    """(key, raw, attempts, error): one row per row that ``gate`` holds for. Rows whose answer fails or is not ``usable`` (an
    expression on it) are asked again as a smaller table, so each try is written before the next and none is repeated."""
    rows = df.where(gate).select(F.col(key).cast("string").alias("key"), prompt.alias("prompt"))
    settled, left = [], rows
    for n in range(1, cfg.max_retries + 1):
        run = _call(generator, system, cfg.reset_interval, cfg.retry_sleep_s if n > 1 else 0)
        good = F.col("error").isNull() & F.coalesce(usable(F.col("raw")), F.lit(False))
        got = materialise(left.mapInArrow(run, ANSWER).select("key", "raw", F.lit(n).alias("attempts"), F.when(~good, F.coalesce("error", F.lit("parse_failed"))).alias("error")), "answers")
        bad = F.col("error").isNotNull()
        if n == cfg.max_retries or got.where(bad).isEmpty():
            settled.append(got)
            break
        settled.append(got.where(~bad))
        left = rows.join(got.where(bad).select("key").distinct(), "key", "left_semi")
    if not settled:
        return rows.select("key", F.lit(None).cast("string").alias("raw"), F.lit(0).alias("attempts"), F.lit("not_asked").alias("error"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def usable_answer(raw):
    """An answer with a JSON object that has keys."""
    v = js.parse_answer(raw)
    return v.isNotNull() & (F.to_json(v) != "{}")


def ingest_prompt():
    return F.concat(F.lit("Document: "), F.col("source"), F.lit("\npage: "), F.col("page").cast("string"), F.lit("\n\n"), F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CHARS))


def enrich(chunks: DataFrame, generator: Generator, cfg: EnrichConfig = EnrichConfig(), profile: str = "cyrillic") -> tuple[DataFrame, DataFrame]:
    """chunks (id, text, source, page, ...) with context and metadata, and the failures as log records."""
    typed = classify(chunks, cfg.skip_first_pages)
    is_data = F.col("chunk_type") == "data"
    answers = ask(typed, "id", ingest_prompt(), is_data, generator, cfg, SYSTEM, usable_answer)
    joined = typed.join(answers.select(F.col("key").alias("id"), "raw", "attempts", "error"), "id", "left")
    v, ok = F.col("v"), F.col("error").isNull() & F.col("v").isNotNull()
    parsed = joined.withColumn("v", F.when(is_data, js.parse_answer(F.col("raw"))))
    fallback = default_context(F.col("text"), 256)
    context = F.when(~is_data, default_context(F.col("text"))).when(ok, js.normalise_context(F.coalesce(F.nullif(js.string_field(v, "context"), F.lit("")), F.nullif("text", F.lit("")), F.lit(NO_TEXT)))).otherwise(fallback)
    fields = {
        "context": context,
        "geo": js.strings_field(v, "geo"),
        "metrics": js.normalise_metrics(js.strings_field(v, "metrics"), profile),
        "years": js.normalise_years(js.strings_field(v, "years")),
        "time_granularity": js.string_field(v, "time_granularity"),
        "oked": js.string_field(v, "oked"),
    }
    kept = [c for c in typed.columns if c not in fields]
    out = parsed.select(*kept, *[e.alias(n) for n, e in fields.items()])
    failures = parsed.where(is_data & ~ok).select(
        F.lit("enrichment_fail").alias("event"), F.coalesce("error", F.lit("parse_failed")).alias("error_type"), F.col("source").alias("pdf_name"), F.col("id").alias("chunk_id"), "page", "attempts",
        F.substring("text", 1, LOG_CHARS).alias("chunk_text"), F.lit(SYSTEM).alias("system_prompt"), ingest_prompt().alias("prompt"), F.col("raw").alias("raw_response"), F.unix_micros(F.current_timestamp()).cast("double").__truediv__(1e6).alias("ts"),
    )
    return post_process(out, cfg.passes), failures


def enrich_queries(queries: DataFrame, generator: Generator, cfg: EnrichConfig = EnrichConfig()) -> DataFrame:
    """queries (query_id, query) with geo, metrics, years, time_granularity, oked, raw_response. A bad answer leaves them empty; errors of
    the model's transport are not caught for good: the answer stays null."""
    prompt = F.concat(F.lit("Question: \n\n"), F.col("query"))
    answers = ask(queries, "query_id", prompt, F.lit(True), generator, cfg, QUERY_SYSTEM, lambda raw: F.lit(True))
    v = F.col("v")
    got = queries.join(answers.select(F.col("key").cast("long").alias("query_id"), F.col("raw").alias("raw_response")), "query_id", "left").withColumn("v", js.parse_query_answer(F.col("raw_response")))
    empty = F.array().cast("array<string>")
    return got.select(
        *queries.columns, F.coalesce(js.strings_field(v, "geo"), empty).alias("geo"), F.coalesce(js.strings_field(v, "metrics"), empty).alias("metrics"),
        F.coalesce(js.normalise_years(js.strings_field(v, "years")), F.array().cast("array<int>")).alias("years"), js.string_field(v, "time_granularity").alias("time_granularity"), js.string_field(v, "oked").alias("oked"), "raw_response",
    )
