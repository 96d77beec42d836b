"""A sink in two phases. Tasks write files that nothing names yet; the job's commit lists them in a pending manifest; publishing
renames that to the table's next version. Readers take the newest version, so a table is whole at any moment: a failed task or
commit, or a check that fails, leaves it as it was.

``df.write.format("versioned").option("version_id", id).save(path)`` is the first phase, :func:`publish` the second.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from trackloom.operators.timeseries import same_rows
from trackloom.sources.store import open_fs

MANIFESTS = "_versions"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class VersionedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, version_id: str):
        self.path, self.version_id = path.rstrip("/"), version_id

    def write(self, iterator: Iterator) -> Written:
        import pyarrow.parquet as pq

        fs, base = open_fs(self.path)
        name, out = f"data/{self.version_id}-{uuid.uuid4().hex}.parquet", None  # a repeated task has a file of its own
        fs.create_dir(f"{base}/data", recursive=True)
        try:
            for batch in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=fs, compression="zstd")
                out.write_batch(batch)
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(f"{base}/{name}")
            raise
        if out is None:
            return Written([])
        out.close()
        return Written([name])

    def commit(self, messages: list) -> None:
        fs, base = open_fs(self.path)
        fs.create_dir(f"{base}/{MANIFESTS}", recursive=True)
        body = json.dumps({"files": sorted(f for m in messages if m for f in m.files)}).encode()
        with fs.open_output_stream(f"{base}/{MANIFESTS}/pending-{self.version_id}.json") as out:
            out.write(body)

    def abort(self, messages: list) -> None:
        fs, base = open_fs(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{base}/{f}")


class VersionedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "versioned"

    def writer(self, schema, overwrite: bool) -> VersionedWriter:
        return VersionedWriter(self.options["path"], self.options["version_id"])


def _manifests(path: str) -> list[int]:
    from pyarrow import fs as pafs

    fs, base = open_fs(path)
    found = fs.get_file_info(pafs.FileSelector(f"{base}/{MANIFESTS}", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())


def _files(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    fs, base = open_fs(path)
    with fs.open_input_stream(f"{base}/{MANIFESTS}/{name}.json") as found:
        files = json.loads(found.read())["files"]
    return spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/{f}" for f in files)) if files else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The table's newest version, or an older one; empty before the first."""
    known = _manifests(path)
    if not known:
        return spark.createDataFrame([], schema)
    return _files(spark, path, f"{version or known[-1]:08d}", schema)


def stage(df: DataFrame, path: str) -> str:
    """First phase: the rows' files and a pending manifest, whose id is returned."""
    version_id = uuid.uuid4().hex
    df.sparkSession.dataSource.register(VersionedSource)
    df.write.format("versioned").option("version_id", version_id).mode("append").save(path)
    return version_id


def publish(path: str, version_id: str) -> int:
    """Second phase: the pending manifest becomes the next version. If another writer took that number, FileExistsError."""
    fs, base = open_fs(path)
    number = (_manifests(path) or [0])[-1] + 1
    target = f"{base}/{MANIFESTS}/{number:08d}.json"
    # a writer who claims a number creates its lock; that fails where it is there already
    if fs.type_name == "local":
        with open(f"{base}/{MANIFESTS}/{number:08d}.lock", "x"):
            pass
    elif fs.get_file_info(target).type.name != "NotFound":
        raise FileExistsError(target)
    fs.move(f"{base}/{MANIFESTS}/pending-{version_id}.json", target)
    return number


def discard(path: str, version_id: str) -> None:
    """Delete what was staged."""
    fs, base = open_fs(path)
    pending = f"{base}/{MANIFESTS}/pending-{version_id}.json"
    with fs.open_input_stream(pending) as found:
        files = json.loads(found.read())["files"]
    fs.delete_file(pending)
    for f in files:
        fs.delete_file(f"{base}/{f}")


def vacuum(path: str, older_than: float = 86400.0) -> int:
    """Delete data files that no manifest names, as tasks leave them that are killed; none younger than ``older_than`` seconds, which
    a running write may still name. How many went."""
    import time

    from pyarrow import fs as pafs

    fs, base = open_fs(path)
    named: set[str] = set()
    for f in fs.get_file_info(pafs.FileSelector(f"{base}/{MANIFESTS}", allow_not_found=True)):
        if f.base_name.endswith(".json"):
            with fs.open_input_stream(f.path) as found:
                named.update(json.loads(found.read())["files"])
    gone = 0
    for f in fs.get_file_info(pafs.FileSelector(f"{base}/data", allow_not_found=True)):
        if f"data/{f.base_name}" not in named and (f.mtime_ns or 0) / 1e9 <= time.time() - older_than:
            fs.delete_file(f.path)
            gone += 1
    return gone


def update(spark: SparkSession, path: str, target: DataFrame, key: str, value: str, merge: Callable[[DataFrame, DataFrame, str, str], DataFrame], schema: str) -> int:
    """A new version with the rows of one key value replaced by ``merge(existing, target, key, value)``, published only if all other rows
    are as they were; else ValueError, and the table stays."""
    old = read(spark, path, schema)
    version_id = stage(merge(old, target, key, value), path)
    others = lambda df: df.filter(~F.col(key).eqNullSafe(F.lit(value)))
    if not same_rows(others(old), others(_files(spark, path, f"pending-{version_id}", schema))):
        discard(path, version_id)
        raise ValueError(f"{path}: rows of other targets would change")
    return publish(path, version_id)
