"""From files to a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import EngineConfig
from ..functions.vectors import Embed, embed_column, hashing_embedder
from ..operators.enrich import enrich
from ..providers import Generator, RuleGenerator
from ..schema import STORE
from ..sources.pages import Extract, fragments, list_sources, pages, pdf_pages, scan_files, with_ids
from ..sources.store import Store, append_log

COLUMNS = [c.split(" ", 1)[0] for c in STORE.split(", ")]


def build_chunks(page_rows: DataFrame, cfg: EngineConfig = EngineConfig(), generator: Generator | None = None, load: Callable[[], Embed] = hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """pages (source, page, text) -> rows of the store, and failure records. Only the context is embedded."""
    chunks, failures = enrich(with_ids(page_rows), generator or RuleGenerator(), cfg.enrich, cfg.profile)
    done = embed_column(chunks, "context", "embedding", cfg.dimension, load, batch=cfg.embed_batch)
    return done.select(*COLUMNS), failures


def build_store(spark: SparkSession, folder: str, store_path: str, cfg: EngineConfig = EngineConfig(), generator: Generator | None = None, extract: Extract = pdf_pages, glob: str = "*.pdf", log_path: str | None = None, load: Callable[[], Embed] = hashing_embedder) -> Store:
    """Files that are there now replace their rows, also those that yield no page; rows of other files stay."""
    files = scan_files(spark, folder, glob)
    seen = list_sources(spark, folder, glob)
    rows, failures = build_chunks(pages(fragments(files, extract)), cfg, generator, load)
    store = Store(spark, store_path)
    store.upsert(rows, seen)
    store.write_metadata(getattr(load, "__name__", "embedder"))
    if log_path:
        append_log(failures, log_path)
    return store
