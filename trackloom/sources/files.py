"""Files: tolerant and validated scans with explicit schemas, scenario writers, text reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators.timeseries import same_rows
from trackloom.sources.store import open_fs

GROUND_TRUTH = "time double, x double, y double, z double, vx double, vy double, vz double, callsign string, lat double, lon double, alt_m double, time_unix double"
ALIASES = {"time": ("time", "t", "timestamp"), "x": ("x", "x_m", "pos_x"), "y": ("y", "y_m", "pos_y"), "z": ("z", "z_m", "alt", "alt_m"), "callsign": ("callsign", "target", "id")}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Headed CSV by column name; columns that a file lacks are null, others are ignored."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = spark.read.option("header", True).csv(path)
    return have.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want))


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As :func:`read_csv`; an absent or empty file is an empty table, all other errors are raised."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def with_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Columns found under any of their names, case-insensitive, as numbers with decimal point or comma."""
    by = {c.lower(): c for c in df.columns}
    found = {name: next((by[a] for a in names if a in by), None) for name, names in aliases.items()}
    number = lambda c: F.regexp_replace(F.trim(F.col(c).cast("string")), ",", ".").try_cast("double")
    return df.select(*((F.lit(None).cast("double") if c is None else F.col(c).cast("string") if name == "callsign" else number(c)).alias(name) for name, c in found.items()))


def validate(df: DataFrame, required: list[str], kind: str) -> DataFrame:
    """``df`` if it has the required columns, at least one row and no null in them; else ValueError. One pass."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{kind}: missing columns {missing}")
    got = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in required)).first()
    if not got["n"]:
        raise ValueError(f"{kind}: no rows")
    if bad := [c for c in required if got[c]]:
        raise ValueError(f"{kind}: nulls in {bad}")
    return df


def normalise_truth(df: DataFrame, scenario: str = "default") -> DataFrame:
    """Truth under one key: the legacy ``target`` column becomes ``callsign``; absent heights are 0."""
    key = "callsign" if "callsign" in df.columns else "target"
    zero = lambda c: F.col(c) if c in df.columns else F.lit(0.0)
    return df.select(F.lit(scenario).alias("scenario"), F.col(key).alias("callsign"), "time", "x", "y", zero("z").alias("z"), "vx", "vy", zero("vz").alias("vz"))


def replace_target(existing: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """``existing`` with the rows of one key value replaced; all other rows unchanged."""
    return existing.filter(~F.col(key).eqNullSafe(F.lit(value))).unionByName(target, allowMissingColumns=True)


def update_in_place(spark: SparkSession, path: str, target: DataFrame, key: str, value: str, merge=replace_target) -> DataFrame:
    """The Parquet table at ``path`` with one key value's rows replaced by ``target``. ``merge(existing, target, key, value)``
    is written beside the table, read back, and takes its place only if all other rows are as they were; else ValueError, and
    the table stays."""
    fs, here = open_fs(path.rstrip("/"))
    staged, aside = f"{here}__staged", f"{here}__aside"
    there = lambda p: fs.get_file_info(p).type.name != "NotFound"
    if there(aside):  # an earlier call ended between its two moves: the table is whole in one place or the other
        if there(here):
            fs.delete_dir(aside)
        else:
            fs.move(aside, here)
    old = spark.read.parquet(path)
    merge(old, target, key, value).write.mode("overwrite").parquet(path.rstrip("/") + "__staged")
    new = spark.read.parquet(path.rstrip("/") + "__staged")
    others = lambda df: df.filter(~F.col(key).eqNullSafe(F.lit(value)))
    if not same_rows(others(old), others(new)):
        fs.delete_dir(staged)
        raise ValueError(f"{path}: rows of other targets would change")
    fs.move(here, aside)
    try:
        fs.move(staged, here)
    except OSError:
        fs.move(aside, here)
        raise
    fs.delete_dir(aside)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(new.schema).parquet(path)


def write_scenario(tables: dict[str, DataFrame], folder: str, window: tuple[float, float] | None = None, fmt: str = "parquet") -> None:
    """Each table under ``folder``: cut to the time window, or whole and in canonical form, without the columns that hold one
    target's extras only."""
    for name, df in tables.items():
        rows = df.filter(F.col("time").between(*window)) if window else df.drop(*(c for c in df.columns if c.startswith("spiral_")))
        writer = rows.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{folder}/{name}")


def report(df: DataFrame, rows: int = 50) -> str:
    return df.limit(rows).toPandas().to_string(index=False)
