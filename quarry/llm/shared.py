"""The folder that driver and executors share, and tables written there.

``spark.checkpoint.dir`` names it on a cluster. Only where that is unset (tests,
a laptop) a temporary folder of this machine is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="quarry-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there, and
    a lost executor costs no more than the tasks that read the table."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(path: str):
    """(filesystem, path in it) for a path with or without a scheme."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    """Atomic: another attempt of the same task writes the same bytes to the same name."""
    from pyarrow import fs as pafs

    fs, p = open_fs(path)
    fs.create_dir(os.path.dirname(p), recursive=True)
    part = f"{p}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    if isinstance(fs, pafs.LocalFileSystem):
        os.replace(part, p)
    else:
        fs.move(part, p)


def map_file(path: str):
    """A read-only memory map of the file, or None if there is none. A file that is not on
    a mounted file system is copied to an unlinked temporary file first."""
    import mmap

    from pyarrow import fs as pafs

    fs, p = open_fs(path)
    if isinstance(fs, pafs.LocalFileSystem):
        if not os.path.exists(p):
            return None
        with open(p, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(p) else None
    if fs.get_file_info(p).type == pafs.FileType.NotFound:
        return None
    with tempfile.TemporaryFile() as tmp, fs.open_input_stream(p) as src:
        while block := src.read(1 << 22):
            tmp.write(block)
        tmp.flush()
        return mmap.mmap(tmp.fileno(), 0, access=mmap.ACCESS_READ)


def malloc_trim():
    """The C library's function that gives free memory back to the system; does nothing where there is none."""
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: None
