"""Files that arrive in a folder, ingested batch by batch into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import EngineConfig
from ..plans.build import build_chunks
from ..sources.pages import Extract, fragments, pages, pdf_pages
from ..sources.store import Store


def ingest_stream(spark: SparkSession, folder: str, store_path: str, checkpoint: str, cfg: EngineConfig = EngineConfig(), generator=None, extract: Extract = pdf_pages, glob: str = "*.pdf", available_now: bool = True):
    """A running query. A batch that is tried again replaces the same sources by the same rows."""
    files = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").option("pathGlobFilter", glob).load(folder)

    def batch(rows: DataFrame, _: int) -> None:
        seen = rows.select(F.element_at(F.split("path", "/"), -1).alias("source"))
        new, _failures = build_chunks(pages(fragments(rows, extract)), cfg, generator)
        Store(spark, store_path).upsert(new, seen)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
