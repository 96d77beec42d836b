"""Shared helpers: tables cut to the shared folder, files that every executor can reach, kernels for byte strings."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Executors must share it, so there is no other choice where it is
    unset: on a cluster a folder of one machine would lose tables silently. On local masters, as in tests, one machine is
    all there is, and a temporary folder does."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return _OWN[app]


def _sweep() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone: the shared folder's own retention applies
            return


atexit.register(_sweep)


ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches, which Spark bounds by rows alone. Its 10,000 rows are some 40 MB of text
    several times over in a task; the session's bound is lowered to ARROW_ROWS where it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


class Scratch:
    """Tables of one operator run under the shared folder. Lineage ends at each saved table, so lost executors cost
    at most the stage that was running; the folder is removed when the driver exits."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        small_batches(spark)
        _MADE.append((spark, self.path))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


SIEVE_BITS = 1 << 24
SIEVE_HASHES = 4


def sieve(rows: DataFrame, wanted: DataFrame, keys: list[str], out: bool = False) -> DataFrame:
    """The rows of ``rows`` whose ``keys`` may be in ``wanted``, before a join with it, so that others need not be shuffled;
    with ``out`` the others, whose keys certainly are not. A Bloom filter of 2 MB at any size: when ``wanted`` has many more
    than a million keys, ever more rows pass and only the saving ends."""
    bits = SIEVE_BITS
    places = F.explode(F.array(*(F.pmod(F.xxhash64(*keys, F.lit(k)), F.lit(bits)) for k in range(SIEVE_HASHES))))
    words = wanted.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = words.toArrow()  # a word for each 64 bits of the filter at most
    table = np.zeros(bits // 64, np.int64)
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(at: pd.DataFrame) -> pd.Series:
        p = at.to_numpy()
        return pd.Series(((sent.value[p >> 6] >> (p & 63)) & 1).all(axis=1))

    hit = held(F.struct(*(F.pmod(F.xxhash64(*keys, F.lit(k)), F.lit(bits)).alias(f"p{k}") for k in range(SIEVE_HASHES))))
    return rows.filter(~hit if out else hit)


def open_fs(uri: str):
    """(filesystem, path) of pyarrow for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> F.Column:
    """A text as its UTF-8 bytes, null as none; Arrow hands these to Python without decoding."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def word_lists(data: bytes, at_once: int) -> Iterator[list[bytes]]:
    """The words of ``data`` between ASCII blanks, ``at_once`` of them at a time."""
    while data:
        found = data.split(None, at_once)
        data = found.pop() if len(found) > at_once else b""
        yield found


def free_name(base: str, names: list[str] | tuple[str, ...]) -> str:
    """A column name that none of ``names`` is, in any case."""
    taken = {n.lower() for n in names}
    while base in taken:
        base += "_"
    return base


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
