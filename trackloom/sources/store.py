"""File systems by URI, the versions of a folder's files, and tables written to the shared folder; the same on the driver and in
tasks, without the JVM."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def open_fs(uri: str):
    """(filesystem, path) for a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def versions(uri: str) -> tuple[tuple[str, int, int], ...]:
    """(path, size, time of change in ns) of every data file under a folder or of a single file; none where nothing is."""
    from pyarrow import fs

    system, path = open_fs(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return ()
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    return tuple(sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; where it is unset, as in tests on a local
    master, a temporary one. Who sets the folder keeps it as short as it likes: nothing in it is needed once the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is read several times is made once, and a lost executor costs no
    more than the reads that it ran."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
