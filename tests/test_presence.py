"""Bitmaps of steps against sets, at steps that need one bitmap and several; edge-and-run spreading against the plain one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gustledger.functions import presence as P
from gustledger.functions import timegrid as tg
from gustledger.operators import alarms as A
from gustledger.operators import quality as Q
from gustledger.plans import scan
from gustledger.sources import state, writers

START = datetime(2024, 1, 1)


def stamped(spark, rows):
    return spark.createDataFrame([("2024-01", s, t) for s, t in rows], "period string, StationId long, TimeStamp timestamp_ntz")


def one_range(spark, end):
    return spark.createDataFrame([("2024-01", START, end)], "period string, range_start timestamp_ntz, range_end timestamp_ntz")


@pytest.mark.parametrize(("seconds", "steps"), [(600, 100), (600, 96), (60, 40_000), (20, 130_000), (600, 1), (600, 7)])
def test_missing_steps_match_sets(spark, seconds, steps):
    rng = random.Random(steps)
    step = timedelta(seconds=seconds)
    lost = {1: set(rng.sample(range(steps), min(steps // 3, 50))), 2: set(), 3: set(range(0, steps, max(steps // 40, 1)))}
    if steps > 50_000:  # whole bitmaps without a step
        lost[2] = set(range(32_768, 65_536))
    have = {s: spark.range(steps).where(~F.col("id").isin(sorted(gone))) if len(gone) < 1000 else spark.range(steps).where("id < 32768 OR id >= 65536") for s, gone in lost.items()}
    rows = None
    for s, ids in have.items():
        part = ids.select(F.lit("2024-01").alias("period"), F.lit(s).cast("long").alias("StationId"), F.timestamp_add("SECOND", F.col("id") * seconds, tg.ntz(START)).alias("TimeStamp"))
        rows = part if rows is None else rows.unionByName(part)
    beside = stamped(spark, [(s, START + timedelta(seconds=1)) for s in (1, 2, 3)] + [(1, START - step), (1, START + steps * step)])
    rows = rows.unionByName(beside).unionByName(rows.limit(5))
    ranges = one_range(spark, START + (steps - 1) * step)
    want = {s: {START + i * step for i in gone} for s, gone in lost.items()}
    got = {s: set() for s in lost}
    for r in Q.missing_timestamps(rows, ranges, step, by=("StationId",)).collect():
        assert r["TimeStamp"] not in got[r["StationId"]]
        got[r["StationId"]].add(r["TimeStamp"])
    assert got == want
    counts = {r["StationId"]: (r["missing_count"], r["total_expected"]) for r in Q.completeness(rows, ranges, step, by=("StationId",)).collect()}
    assert counts == {s: (len(gone), steps) for s, gone in lost.items()}
    everywhere = set.intersection(*want.values())
    assert {r["TimeStamp"] for r in Q.missing_timestamps(rows, ranges, step).collect()} == everywhere


def test_month_without_rows_and_range_without_stamps(spark):
    step = timedelta(minutes=10)
    none = stamped(spark, [])
    ranges = one_range(spark, START + 4 * step)
    assert Q.missing_timestamps(none, ranges, step).count() == 5 and Q.missing_timestamps(none, ranges, step, by=("StationId",)).count() == 0
    assert Q.completeness(none, ranges, step).first()["completeness_percentage"] == 0
    empty = one_range(spark, START - step)
    assert Q.missing_timestamps(none, empty, step).count() == 0 and Q.completeness(stamped(spark, [(1, START)]), empty, step).first()["total_expected"] == 0
    with pytest.raises(Exception, match="longer than a month"):
        late = stamped(spark, [(1, START + timedelta(days=400))])
        Q.completeness(late, one_range(spark, START + timedelta(days=500)), step).collect()


def test_step_lookup(spark):
    row = spark.range(100).where("id % 7 = 3").agg(P.steps_seen(F.col("id"), timedelta(minutes=10)).alias("b"))
    got = row.select(*[P.has_step(F.col("b"), F.lit(i).cast("long")).alias(f"s{i}") for i in range(100)], P.steps_counted(F.col("b")).alias("n")).first()
    assert [got[f"s{i}"] for i in range(100)] == [i % 7 == 3 for i in range(100)] and got["n"] == 14


def test_edges_and_runs_match_spreading_every_interval(spark, alarms):
    """Alarms that touch, meet inside one interval, start on a stamp, or last days; two types, two stations, several steps."""
    rng = random.Random(8)
    rows, ident = [], 0
    for station in (1, 2):
        t = START + timedelta(seconds=rng.randint(0, 900))
        for _ in range(120):
            length = rng.choice([7, 300, 600, 1200, 601, 86_400, 200_000])
            rows.append(("2024-01", ident, t, t + timedelta(seconds=length), station, ident % 2, f"text {ident}"))
            ident += 1
            t += timedelta(seconds=length + rng.choice([0, 0, 1, 300, 600, 5000]))
            if rng.random() < 0.2:  # on a stamp exactly
                t += timedelta(seconds=(-(t - START).total_seconds()) % 600)
    al = spark.createDataFrame(rows, "period string, ID long, TimeOn timestamp_ntz, TimeOff timestamp_ntz, StationNr long, `Error Type` int, `UK Text` string")
    al = al.withColumn("NewTimeOn", F.col("TimeOn"))
    for step in (timedelta(minutes=10), timedelta(hours=1), timedelta(seconds=30)):
        got, want = A.stopped_by_interval(al, step), A.alarm_by_interval(A.to_intervals(al, step))
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert A.stopped_by_interval(al.limit(0)).count() == 0
    backward = al.limit(1).withColumn("TimeOff", tg.plus(F.col("TimeOn"), timedelta(hours=-2)))
    assert A.stopped_by_interval(backward).count() == A.to_intervals(backward).count() == 0


def test_months_come_from_file_names(spark, tmp_path):
    path = str(tmp_path / "met")
    names = ["met_WindSpeedRot_mean"]
    rows = spark.range(288).select(
        F.when(F.col("id") < 144, "2024-01").otherwise("2024-02").alias("period"), F.lit(1).cast("long").alias("StationId"),
        F.timestamp_add("MINUTE", F.pmod("id", F.lit(144)) * 10, F.when(F.col("id") < 144, tg.ntz(START)).otherwise(tg.ntz("2024-02-01 00:00:00"))).alias("TimeStamp"),
        *[F.col("id").cast("double").alias(n) for n in names],
    )
    writers.write_partitioned(rows, path)
    manifest = state.month_manifest(spark, path)
    assert sorted((r["period"], r["files"] > 0, r["bytes"] > 0) for r in manifest.collect()) == [("2024-01", True, True), ("2024-02", True, True)]
    ranges = scan.scan_ranges(manifest, "2024-02-01 10:00:00")
    text = ranges._jdf.queryExecution().executedPlan().toString()
    # Only names of files are read.
    assert text.count("ReadSchema") == 1 and "ReadSchema: struct<path:string>" in text
    met = spark.read.parquet(path)
    with_manifest, plain = (scan.validation_scan(met, "2024-02-01 10:00:00", manifest=m)[0].collect() for m in (manifest, None))
    assert sorted(map(str, with_manifest)) == sorted(map(str, plain))
    issues, summary = scan.scan_report(met, "2024-02-01 10:00:00", str(tmp_path / "report"), manifest=manifest)
    assert summary.first()["total_files_scanned"] == 2 and summary.first()["total_issues"] == issues.count()
    (tmp_path / "raw").mkdir()
    for name in ("2023-11-met.csv", "2023-12-met.csv", "notes.csv"):
        (tmp_path / "raw" / name).write_text("a\n1\n")
    assert sorted(r["period"] for r in state.month_manifest(spark, str(tmp_path / "raw"), "*.csv").collect()) == ["2023-11", "2023-12"]
