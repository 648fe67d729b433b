"""From files to page chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import chunk_id, strip
from ..operators.index import with_dense_index
from ..schema import FRAGMENTS

#: (file name, bytes) -> (page_label, page_number, page, text) of each fragment in order
Extract = Callable[[str, bytes], Iterable[tuple[str | None, str | None, str | None, str]]]


def form_feed_pages(name: str, data: bytes):
    """Plain text whose pages end with form feeds."""
    for n, text in enumerate(data.decode("utf-8", "replace").split("\f"), 1):
        yield str(n), None, None, text


def pdf_pages(name: str, data: bytes):
    """Pages of a PDF; needs the pypdf package."""
    import io

    from pypdf import PdfReader

    for n, page in enumerate(PdfReader(io.BytesIO(data)).pages, 1):
        yield str(n), None, None, page.extract_text() or ""


def scan_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, content) of the folder's own files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")


def list_sources(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(source): the names of the folder's own files, empty ones too (a scan has no row for those)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{glob}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return spark.createDataFrame([(f.getPath().getName(),) for f in found if f.isFile()], "source string")


def fragments(files: DataFrame, extract: Extract = pdf_pages) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        types = [pa.string()] * 4 + [pa.int64(), pa.string()]
        names = ["source", "page_label", "page_number", "page", "fragment_no", "fragment"]
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                source = path.rsplit("/", 1)[-1]
                rows = [(source, label, number, page, i, text) for i, (label, number, page, text) in enumerate(extract(source, data.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    return files.select("path", "content").mapInArrow(run, FRAGMENTS)


def page_number(label: Column, number: Column, page: Column) -> Column:
    """The first that is set decides; if it is no whole number, 0."""
    return F.coalesce(F.trim(F.coalesce(label, number, page)).try_cast("int"), F.lit(0))


def pages(frags: DataFrame) -> DataFrame:
    """(source, page, text): fragments of a page in order, joined by line ends, stripped; empty pages fall out."""
    of = frags.select("source", page_number(F.col("page_label"), F.col("page_number"), F.col("page")).alias("page"), F.struct("fragment_no", "fragment").alias("f"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["fragment"]), "\n")
    return of.groupBy("source", "page").agg(strip(text).alias("text")).where(F.col("text") != "")


def with_ids(page_rows: DataFrame) -> DataFrame:
    """Adds pos (dense, by source and page) and the id made of it."""
    out = with_dense_index(page_rows, "source", "page")
    return out.withColumn("id", chunk_id(F.col("source"), F.col("page"), F.col("pos")))
