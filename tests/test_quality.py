"""Completeness, stuck and range checks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gustledger.operators import quality as Q
from gustledger.plans.scan import validation_scan

BASE = datetime(2025, 1, 1)


def stamps(spark, minutes):
    return spark.createDataFrame(
        [("2025-01", BASE + timedelta(minutes=m)) for m in minutes], "period string, TimeStamp timestamp_ntz"
    )


def span(spark, minutes):
    return spark.createDataFrame(
        [("2025-01", BASE, BASE + timedelta(minutes=minutes))], "period string, range_start timestamp_ntz, range_end timestamp_ntz"
    )


@pytest.mark.parametrize(
    "present, until, missing, expected, percent",
    [
        (range(0, 61, 10), 60, 0, 7, 100.0),
        ([0, 20], 30, 2, 4, 50.0),
        ([], 60, 7, 7, 0.0),
        ([0, 30], 20, 2, 3, 33.33),
        ([0, 5, 10, 10], 20, 1, 3, 66.67),
    ],
)
def test_completeness(spark, present, until, missing, expected, percent):
    row = Q.completeness(stamps(spark, present), span(spark, until)).first()
    assert (row["missing_count"], row["total_expected"], row["completeness_percentage"]) == (missing, expected, percent)
    assert Q.missing_timestamps(stamps(spark, present), span(spark, until)).count() == missing


def test_completeness_with_open_end(spark):
    row = Q.completeness(stamps(spark, [0, 10]), span(spark, 20), end_inclusive=False).first()
    assert (row["missing_count"], row["total_expected"]) == (0, 2)


def test_missing_list_is_cut_after_ten(spark):
    missing = Q.missing_timestamps(stamps(spark, [0]), span(spark, 130))
    row = Q.first_ten(missing, ["period"]).first()
    assert row["count"] == 13 and len(row["missing_timestamps"]) == 11
    assert row["missing_timestamps"][0] == "2025-01-01T00:10:00" and row["missing_timestamps"][-1] == "... and 3 more"


def wind(spark, values, stats=("mean", "min", "max", "stddev"), station=1):
    """Rows with the given wind tuples, one per ten minutes."""
    return spark.createDataFrame(
        [("2025-01", station, BASE + timedelta(minutes=10 * i), *v) for i, v in enumerate(values)],
        "period string, StationId long, TimeStamp timestamp_ntz, " + ", ".join(f"met_WindSpeedRot_{s} double" for s in stats),
    )


def test_out_of_range_values_are_removed(spark):
    df = spark.createDataFrame(
        [("2025-01", 1, BASE, 10.5, -60.0, 1013.0, 180.0), ("2025-01", 1, BASE + timedelta(minutes=10), 100.0, 20.0, 700.0, 400.0)],
        "period string, StationId long, TimeStamp timestamp_ntz, met_WindSpeedRot_mean double, met_TemperatureTen_mean double, "
        "met_Pressure_mean double, met_WinddirectionRot_mean double",
    )
    got = [tuple(r)[3:] for r in Q.nullify_met(df).orderBy("TimeStamp").collect()]
    assert got == [(10.5, None, 1013.0, 180.0), (None, 20.0, None, None)]


def test_stuck_statistics_are_removed_together(spark):
    df = wind(spark, [(12.0, 11.0, 13.0, 0.5)] * 4).withColumn(
        "met_TemperatureTen_mean", F.when(F.minute("TimeStamp") == 10, 20.1).otherwise(20.0)
    )
    out = Q.nullify_met(df).orderBy("TimeStamp").collect()
    assert all(r[f"met_WindSpeedRot_{s}"] is None for r in out for s in ("mean", "min", "max", "stddev"))
    assert [r["met_TemperatureTen_mean"] for r in out] == [20.0, 20.1, 20.0, 20.0]


def test_stuck_zero_is_removed_by_default(spark):
    assert Q.nullify_met(wind(spark, [(0.0,) * 4] * 4)).where("met_WindSpeedRot_mean IS NOT NULL").count() == 0


def flags(df, n, **more):
    return [r["stuck"] for r in Q.stuck_flag(df, "met_WindSpeedRot", n, **more).orderBy("TimeStamp").collect()]


def test_run_length(spark):
    df = wind(spark, [(v, v, v, 0.0) for v in (10.0, 10.0, *map(float, range(12, 20)))])
    assert not any(flags(df, 3))
    assert flags(df, 2) == [True, True] + [False] * 8
    issues = Q.stuck_issues(df, 2).collect()
    assert [(i["sensor"], i["count"]) for i in issues] == [("met_WindSpeedRot", 2)]
    assert Q.stuck_issues(df).count() == 0


def test_zeros_can_be_left_out(spark):
    df = wind(spark, [(0.0,) * 4] * 10)
    assert all(flags(df, None)) and not any(flags(df, 3, exclude_zero=True))


def test_missing_value_breaks_a_run_and_stations_are_apart(spark):
    df = wind(spark, [(1.0,), (1.0,), (None,), (1.0,), (1.0,)], stats=("mean",))
    assert not any(flags(df, 3)) and flags(df, 2) == [True, True, False, True, True]
    both = df.unionByName(wind(spark, [(1.0,)], stats=("mean",), station=0))
    assert Q.stuck_flag(both, "met_WindSpeedRot", 2).where("StationId = 0 AND stuck").count() == 0


def test_length_one_flags_only_repeats(spark):
    assert flags(wind(spark, [(1.0,), (1.0,), (2.0,)], stats=("mean",)), 1) == [False, True, False]


@pytest.mark.parametrize("n", [2, 3, 5])
def test_runs_against_a_loop(spark, n):
    values = [1.0, 1.0, 1.0, 2.0, 2.0, None, None, 3.0, 3.0, 3.0, 3.0, 3.0, 4.0, 4.0]
    expected, i = [], 0
    while i < len(values):
        j = i + 1
        while j < len(values) and values[i] is not None and values[j] == values[i]:
            j += 1
        expected += [j - i >= n and n > 1] * (j - i)
        i = j
    assert flags(wind(spark, [(v,) for v in values], stats=("mean",)), n) == expected


def test_scan_reports_each_kind_and_keeps_months_apart(spark):
    rows = []
    for month in (1, 2):
        for i in range(6):
            if i == 3:
                continue  # a stamp nobody sent
            for station in (38, 39):
                empty = station == 39 and i == 1
                wind_value = None if empty else (60.0 if i == 5 else 5.0 + i)
                pressure = None if empty or i == 2 else 1000.0
                rows.append((f"2025-{month:02d}", station, datetime(2025, month, 1) + timedelta(minutes=10 * i), wind_value, pressure))
    met = spark.createDataFrame(rows, "period string, StationId long, TimeStamp timestamp_ntz, met_WindSpeedRot_mean double, met_Pressure_mean double")
    issues, summary = validation_scan(met, datetime(2025, 2, 1, 0, 50), last_day="2025-02-01 00:00:00", periods=["2025-02"])
    found = {(r["type"], r["station_id"], r["sensor"] or r["column"]): r["count"] for r in issues.collect()}
    assert found == {
        ("system_completeness", "ALL", "Global Connectivity"): 1,
        ("system_completeness", "ALL", "met_Pressure"): 1,
        ("completeness", "38", None): 1,
        ("completeness", "39", None): 1,
        ("empty_row", "39", "ALL"): 1,
        ("sensor_gap", "38", "met_Pressure"): 1,
        ("sensor_gap", "39", "met_Pressure"): 1,
        ("out_of_range", "38", "met_WindSpeedRot_mean"): 1,
        ("out_of_range", "39", "met_WindSpeedRot_mean"): 1,
    }
    totals = summary.first().asDict()
    assert (totals["total_files_scanned"], totals["files_with_issues"], totals["total_issues"]) == (1, 1, 9)
    assert (totals["system_issues_count"], totals["stuck_values_count"], totals["out_of_range_count"]) == (2, 0, 2)
    both = validation_scan(met, datetime(2025, 2, 1, 0, 50))[1].first()
    assert both["total_files_scanned"] == 2 and both["files_with_issues"] == 2


def test_scan_without_rows_in_the_wanted_days(spark):
    met = wind(spark, [(1.0,)], stats=("mean",))
    issues, summary = validation_scan(met, datetime(2025, 3, 1), first_day="2025-02-01 00:00:00")
    assert issues.count() == 0 and summary.first()["total_files_scanned"] == 0
