import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackloom.operators.timeseries import same_rows
from trackloom.sources import files, versioned
from trackloom.sources.cache import ScanCache
from trackloom.sources.replay import ReplayReader, ReplaySource
from trackloom.sources.store import versions

ROW = "callsign string, time double, x double"


def rows(spark, n=40):
    return spark.range(n).select(F.concat(F.lit("T"), F.col("id") % 4).alias("callsign"), (F.col("id") * 0.5).alias("time"), F.rand(1).alias("x"))


def test_cache_notices_changed_files(spark, tmp_path):
    path, reads = str(tmp_path / "t"), []
    rows(spark).coalesce(1).write.parquet(path)

    def read(session, p):
        reads.append(p)
        return session.read.parquet(p)

    with ScanCache(spark, most=2) as cache:
        first = cache.scan(path, read)
        assert first.count() == 40 and cache.scan(path, read) is first and len(reads) == 1 and first.storageLevel.useMemory
        rows(spark, 8).coalesce(1).write.mode("append").parquet(path)
        second = cache.scan(path, read)
        assert second.count() == 48 and len(reads) == 2
        data = next(f for f, _, _ in versions(path))
        os.utime(data, (1, 1))
        cache.scan(path, read)
        assert len(reads) == 3
        for k in range(3):
            rows(spark).write.parquet(f"{path}{k}")
            cache.scan(f"{path}{k}", read)
        assert len(cache.held) == 2
    assert not cache.held and not second.storageLevel.useMemory and versions(str(tmp_path / "none")) == ()


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versioned.read(spark, path, ROW).count() == 0
    one = rows(spark)
    one = spark.createDataFrame(one.collect(), ROW)
    assert versioned.publish(path, versioned.stage(one.repartition(3), path)) == 1
    target = spark.createDataFrame([("T1", 1.0, 9.0)], ROW)
    assert versioned.update(spark, path, target, "callsign", "T1", files.replace_target, ROW) == 2
    want = one.filter("callsign <> 'T1'").union(target)
    assert same_rows(want, versioned.read(spark, path, ROW)) and same_rows(one, versioned.read(spark, path, ROW, 1))
    # a merge that touches other rows, and a version that another writer has taken
    before = versions(path)
    with pytest.raises(ValueError, match="other targets"):
        versioned.update(spark, path, target, "callsign", "T1", lambda old, new, *_: new, ROW)
    assert versions(path) == before and same_rows(want, versioned.read(spark, path, ROW))
    staged = versioned.stage(one, path)
    (tmp_path / "t" / versioned.MANIFESTS / "00000003.lock").touch()
    with pytest.raises(FileExistsError):
        versioned.publish(path, staged)
    versioned.discard(path, staged)
    assert [v for v in versions(path) if not v[0].endswith(".lock")] == [v for v in before if not v[0].endswith(".lock")]


def test_a_failed_task_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.publish(path, versioned.stage(rows(spark), path))
    before = versions(path)
    broken = rows(spark).repartition(4).withColumn("x", F.when(F.col("time") == 13.0, F.raise_error(F.lit("broken"))).otherwise(F.col("x")))
    with pytest.raises(PySparkException):
        versioned.stage(broken, path)
    assert versioned.read(spark, path, ROW).count() == 40
    time.sleep(2)  # tasks that are killed with the job may leave files that nothing names
    assert versioned.vacuum(path) == 0
    versioned.vacuum(path, older_than=0.0)
    assert versions(path) == before and versioned.read(spark, path, ROW).count() == 40


def test_a_failed_commit_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.publish(path, versioned.stage(rows(spark), path))
    manifests = tmp_path / "t" / versioned.MANIFESTS
    aside = tmp_path / "aside"
    manifests.rename(aside)
    manifests.write_text("no folder")  # the commit can't write here
    with pytest.raises(PySparkException):
        versioned.stage(rows(spark, 8), path)
    manifests.unlink()
    aside.rename(manifests)
    assert versioned.read(spark, path, ROW).count() == 40 and len(versions(path)) == len({f for f, _, _ in versions(path)})


def replayed(spark, path, at, **options):
    spark.dataSource.register(ReplaySource)
    stream = spark.readStream.format("replay").options(path=path, step="2.0", **options).load()
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def test_replay_goes_on_where_it_stopped(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "run")
    rows(spark).repartition(3).write.parquet(path)
    whole = spark.read.parquet(path)
    begun = time.time() - 3.0  # three steps of two seconds are over
    part = replayed(spark, path, at, speed="2.0", started=str(begun))
    seen = part.agg(F.max("time").alias("t"), F.count("*").alias("n")).first()
    assert 0 < seen.n < 40 and seen.n == whole.filter(F.col("time") <= seen.t).count()
    assert same_rows(replayed(spark, path, at), whole)
    assert replayed(spark, path, at).count() == 40  # nothing is handed on twice


def test_replay_offsets(spark, tmp_path):
    path = str(tmp_path / "in")
    rows(spark).coalesce(1).write.parquet(path)
    reader = ReplayReader({"path": path, "step": "5.0"})
    assert reader.initialOffset() == {"step": 0} and reader.latestOffset() == {"step": 4}
    steps = reader.partitions({"step": 1}, {"step": 3})
    got = [b.column("time").to_pylist() for s in steps for b in reader.read(s)]
    assert [t for own in got for t in own] == [k * 0.5 for k in range(10, 30)]
    rows(spark).limit(0).coalesce(1).write.parquet(str(tmp_path / "none"))
    assert ReplayReader({"path": str(tmp_path / "none")}).latestOffset() == {"step": 0}
