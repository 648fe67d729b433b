"""The chunk store: layers of Parquet tables, and numbered commits that name them.

A layer holds the rows that one upsert brought and the sources it saw; rows of older layers count unless a newer layer saw their
source. A commit is a small file whose number no other commit has: it is created without overwriting, holds the layers'
names, oldest first, and is never deleted or changed, so readers see the rows before an upsert or after it, also if the
writer dies. Who finds the next number taken reads the newest commit again and adds its layer to that. An upsert
writes its own rows alone; after ``MAX_LAYERS`` layers they are written as one.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import CHUNKS, STORE

MAX_LAYERS = 8


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.path}/commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []

    def current(self) -> tuple[int, list[str]]:
        """The newest commit's number and layers; (0, []) for a store that has none yet. A commit without its closing mark
        is being written, or its writer died: it counts as absent."""
        for n in reversed(self._numbers()):
            lines = [r[0] for r in self.spark.read.text(f"{self.path}/commits/{n:012d}").collect()]
            if lines[-1:] == ["."]:
                return n, lines[:-1]
        return 0, []

    def _commit(self, number: int, layers: list[str]) -> bool:
        """Whether the number was free."""
        fs, path = self._fs()
        try:
            out = fs.create(path(f"{self.path}/commits/{number:012d}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray("\n".join([*layers, "."]).encode()))
        out.close()
        return True

    def read(self) -> DataFrame:
        return self._rows(self.current()[1])

    def _rows(self, layers: list[str]) -> DataFrame:
        out, newer = self.spark.createDataFrame([], STORE), None
        for name in reversed(layers):
            rows = self.spark.read.schema(STORE).parquet(f"{self.path}/{name}/rows")
            seen = self.spark.read.schema("source STRING").parquet(f"{self.path}/{name}/seen")
            out = out.unionByName(rows if newer is None else rows.join(newer, "source", "left_anti").select(*rows.columns))
            newer = seen if newer is None else newer.union(seen)
        return out

    def _layer(self, rows: DataFrame, seen: DataFrame) -> str:
        name = f"layer-{uuid.uuid4().hex}"
        rows.select(*[c.split(" ", 1)[0] for c in STORE.split(", ")]).write.parquet(f"{self.path}/{name}/rows")
        seen.select(F.col("source").cast("string")).distinct().write.parquet(f"{self.path}/{name}/seen")
        return name

    def write(self, rows: DataFrame) -> str:
        """The store's rows are these alone."""
        name = self._layer(rows, rows)
        while not self._commit(self._next(), [name]):
            pass
        return name

    def _next(self, patience: float = 5.0) -> int:
        """The number after the newest; a commit that is being written gets some time to end."""
        until = time.monotonic() + patience
        while (numbers := self._numbers()) and self.current()[0] != numbers[-1] and time.monotonic() < until:
            time.sleep(0.1)
        return numbers[-1] + 1 if numbers else 1

    def upsert(self, new: DataFrame, seen_sources: DataFrame) -> str:
        """Rows of the seen sources are replaced by the new ones, also by none; others stay."""
        name = self._layer(new, seen_sources)
        while True:
            number = self._next()
            layers = [*self.current()[1], name]
            if self._commit(number, layers):
                break
        if len(layers) > MAX_LAYERS:
            rows = self._rows(layers)
            self._commit(number + 1, [self._layer(rows, rows)])  # else: newer rows came, and the next upsert tries again
        return name

    def load(self) -> DataFrame:
        """read() of a store that adds up; ValueError if vectors are missing."""
        rows = self.read()
        check_integrity(rows)
        return rows

    def metadata(self, vectorizer: str) -> DataFrame:
        return self.read().agg(F.lit(vectorizer).alias("vectorizer"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"), F.count("*").alias("chunks"))

    def write_metadata(self, vectorizer: str) -> None:
        self.metadata(vectorizer).coalesce(1).write.mode("overwrite").json(f"{self.path}/metadata")


def upsert(old: DataFrame, new: DataFrame, seen_sources: DataFrame) -> DataFrame:
    """Old rows without those of ``seen_sources`` (source), and all new rows."""
    return old.join(seen_sources.select("source").distinct(), "source", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_sources(old: DataFrame, sources: DataFrame) -> DataFrame:
    return old.join(sources.select("source").distinct(), "source", "left_anti").select(*old.columns)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """A store written as one JSON array, or as JSON lines (export_json): missing years are empty, other keys land in ``extra``."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is not None and first[0].lstrip().startswith("["):
        raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.try_variant_get(F.parse_json("value"), "$", "array<variant>")).alias("v"))
    else:
        raw = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    fields = [c.split(" ", 1) for c in CHUNKS.split(", ")]
    cols = [F.try_variant_get("v", f"$.{n}", t.lower()).alias(n) for n, t in fields]
    extra = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: ~k.isin(*[n for n, _ in fields]))
    got = raw.select(*cols, F.transform_values(extra, lambda _, x: F.to_json(x)).alias("extra"))
    return got.withColumn("years", F.coalesce("years", F.array().cast("array<int>"))).withColumn("page", F.coalesce("page", F.lit(0)))


def export_json(chunks: DataFrame, path: str) -> None:
    chunks.select(*[c.split(" ", 1)[0] for c in CHUNKS.split(", ")]).write.mode("overwrite").json(path)


def append_log(records: DataFrame, path: str) -> None:
    """JSON lines; records without a time get one."""
    ts = F.unix_micros(F.current_timestamp()).cast("double") / 1e6
    with_ts = records.withColumn("ts", F.coalesce("ts", ts)) if "ts" in records.columns else records.withColumn("ts", ts)
    with_ts.write.mode("append").json(path)


def integrity(chunks: DataFrame) -> DataFrame:
    """One row: rows, rows with a vector, blank contexts (which have none), and whether that adds up."""
    blank = F.coalesce(F.trim("context"), F.lit("")) == ""
    got = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"), F.count_if(blank & F.col("embedding").isNull()).alias("blank"))
    return got.withColumn("ok", F.col("chunks") == F.col("vectors") + F.col("blank"))


def check_integrity(chunks: DataFrame) -> None:
    row = integrity(chunks).first()
    if not row["ok"]:
        raise ValueError(f"{row['vectors']} vectors for {row['chunks']} chunks")
