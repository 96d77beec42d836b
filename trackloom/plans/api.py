"""Entry points: fuse files, benchmark algorithms, diagnose associations, profile sensors."""

from __future__ import annotations

import argparse
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import scoring, tracking
from trackloom.sources import files
from trackloom.sources.store import settled

ALGORITHMS = ("basic", "advanced", "advanced_fixed_q", "imm")


def sensor_table(df: DataFrame, scenario: str = "default") -> DataFrame:
    """Any sensor file's rows with the columns the trackers want; absent ones are null."""
    names = [c.split() for c in tracking.SENSOR.split(", ")]
    have = {"scenario": F.lit(scenario), "ord": F.monotonically_increasing_id()}
    return df.select(*((F.col(n) if n in df.columns else have.get(n, F.lit(None))).cast(t).alias(n) for n, t in names))


def run_fusion(spark: SparkSession, sensor_path: str, output_path: str | None = None, algorithm: str = "imm") -> DataFrame:
    raw = files.read_csv(spark, sensor_path, ", ".join(c for c in tracking.SENSOR.split(", ") if c.split()[0] not in ("scenario", "ord")))
    fused = tracking.fuse(sensor_table(files.validate(raw, ["time", "sensor", "local_track_id", "x", "vx", "y", "vy"], "sensor")), algorithm)
    if output_path:
        fused.write.mode("overwrite").option("header", True).csv(output_path)
    return fused


def benchmark(sensor: DataFrame, gt: DataFrame, algorithms: tuple[str, ...] = ALGORITHMS, gate: float = 400.0) -> tuple[DataFrame, DataFrame]:
    """(overall, per target) scores of every algorithm over all distinct sensor times."""
    times = sensor.select("scenario", "time").distinct()
    overall = targets = None
    for a in algorithms:
        fused = settled(tracking.fuse(sensor, a, scoring.TRACK), f"fused-{a}")
        both = [f(fused, gt, times, gate).withColumn("algorithm", F.lit(a)) for f in (scoring.tracking_metrics, scoring.target_metrics)]
        overall, targets = both if overall is None else (overall.unionByName(both[0]), targets.unionByName(both[1]))
    return overall, targets


EVENTS = "scenario string, event_type string, time double, label string, sensor string, local_track_id string, accepted_stage string, assigned_global_track_id string"


def diagnose(sensor: DataFrame, algorithm: str = "imm") -> DataFrame:
    """A row for each measurement: the stage that accepted it (source_map, hungarian, revive, create) and its track."""

    names = [c.split()[0] for c in EVENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in tracking.whole_scenarios(batches):
            notes: list[tuple] = []
            for _ in tracking.steps(frame, algorithm, notes):
                if len(notes) >= tracking.ROWS:
                    yield rows(notes)
                    notes.clear()
            if notes:
                yield rows(notes)

    def rows(notes: list[tuple]) -> pa.RecordBatch:
        got = ((e.scenario, "measurement", time, m.label, m.sensor, m.source[1], stage, track) for e, time, m, stage, track in notes)
        return tracking.record_batch(dict(zip(names, zip(*got))), EVENTS)

    return tracking.by_scenario(sensor).mapInArrow(run, EVENTS)


DEBUG = (
    "scenario string, event_type string, time double, label string, sensor string, local_track_id string, source_map_found boolean, active_track_count int, predicted_global_track_id string, "
    "position_innovation_m double, velocity_innovation_mps double, d2 double, base_gate double, effective_gate double, q_scale double, maneuver_score double, last_nis double, assignment_cost double, "
    "accepted_global_track_id string, created_global_track_id string, measurement_accepted boolean, result string, assigned_global_track_id string, was string, labels array<string>"
)


def association_debug(sensor: DataFrame, algorithm: str = "advanced") -> DataFrame:
    """A row for each measurement with the innovations, distance and gates of the track that took it, or of the one that
    should have, and the reasons; and one for each deletion of a track, with its status before and its measurements' labels."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        engine, events = tracking.Engine(algorithm), []
        for time, ms in tracking.measurements(frame, engine.policy):
            engine.step(time, ms, events)
        # kinds of events have different columns: None, not NaN, where one has none
        got = pd.DataFrame(events, columns=[c.split()[0] for c in DEBUG.split(", ")][1:], dtype=object)
        got = got.where(got.notna(), None)
        got.insert(0, "scenario", str(frame["scenario"].iloc[0]))
        return got

    return sensor.groupBy("scenario").applyInPandas(run, DEBUG)


def debug_summary(debug: DataFrame, target: str) -> DataFrame:
    """``scenario`` and the counts of one target's measurements by result, its tracks, and the largest adaptive values."""
    own = debug.filter((F.col("event_type") == "measurement") & (F.col("label") == target))
    why = lambda x: F.count_if(F.col("result").contains(x))
    made = F.count("created_global_track_id")
    ids = F.count_distinct(F.coalesce("accepted_global_track_id", "created_global_track_id"))
    rows = own.groupBy("scenario").agg(
        F.count("*").alias("total_measurements"), F.count_if("measurement_accepted").alias("accepted"), F.count_if(~F.col("measurement_accepted")).alias("rejected"), F.count_if(F.col("d2") < F.col("effective_gate")).alias("gate_inside"),
        why("MAHALANOBIS_GATE_FAIL").alias("gate_rejected"), why("VELOCITY_GATE_FAIL").alias("velocity_rejected"), why("HUNGARIAN_NOT_SELECTED").alias("hungarian_rejected"), made.alias("new_tracks"), F.greatest(made - 1, F.lit(0)).alias("track_recreations"),
        ids.alias("unique_global_track_ids"), F.max("q_scale").alias("max_q_scale"), F.max("maneuver_score").alias("max_maneuver_score"), F.max("effective_gate").alias("max_effective_gate"),
    )
    gone = debug.filter((F.col("event_type") == "track_deleted") & F.array_contains("labels", target)).groupBy("scenario").agg(F.count("*").alias("track_deletions"), F.count_if(F.col("was") == "CONFIRMED").alias("confirmed_track_deletions"), F.count_if(F.col("was") == "TENTATIVE").alias("tentative_track_deletions"))
    return rows.join(gone, "scenario", "left").fillna(0, ["track_deletions", "confirmed_track_deletions", "tentative_track_deletions"])


def diagnosis_summary(events: DataFrame) -> DataFrame:
    stage = F.col("accepted_stage")
    return events.groupBy("scenario", "label").agg(F.count("*").alias("n"), *(F.count_if(stage == x).alias(x) for x in ("source_map", "hungarian", "revive", "create")), F.count_distinct("assigned_global_track_id").alias("tracks"), F.array_join(F.array_sort(F.collect_set("sensor")), ", ").alias("sensors"))


def sensor_profile(sensor: DataFrame) -> DataFrame:
    return sensor.groupBy("callsign_true", "sensor").agg(F.count("*").alias("n"), F.count_distinct("local_track_id").alias("local_tracks"), F.min("time").alias("first"), F.max("time").alias("last"), F.avg("track_quality").alias("mean_quality"), F.avg(F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)).alias("mean_speed"), F.count_if("is_clutter").alias("clutter"))


def main() -> None:
    parser = argparse.ArgumentParser(description="Fuse a sensor file")
    parser.add_argument("sensor")
    parser.add_argument("output")
    parser.add_argument("--algorithm", choices=ALGORITHMS, default="imm")
    a = parser.parse_args()
    run_fusion(SparkSession.builder.getOrCreate(), a.sensor, a.output, a.algorithm)


if __name__ == "__main__":
    main()
