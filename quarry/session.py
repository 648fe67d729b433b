"""A session with the settings results depend on, and the folder shared with executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "quarry", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:  # a single machine
        app = spark.sparkContext.applicationId
        if app not in _own:
            folder = tempfile.mkdtemp(prefix="quarry-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[app] = "file://" + folder
        top = _own[app]
    return f"{top.rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the shared folder: computed once, lineage cut."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
