"""Hand-made alarm cases, and comparisons with a plain loop on random logs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gustledger.operators import alarms as A
from gustledger.operators.blocks import first_at_or_after, running_max_before


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_cascade_root_child_embedded(alarms):
    df = A.cascade(
        alarms([(s * 10 + i, on, off, 1001, i % 2, s) for s in (1, 2) for i, (on, off) in enumerate([("10:00", "11:00"), ("10:30", "11:30"), ("10:40", "10:50")])])
    )
    assert rows(df, "ID", "EffectiveAlarmTime") == [(10, 3600.0), (11, 1800.0), (12, 0.0), (20, 3600.0), (21, 1800.0), (22, 0.0)]
    assert rows(df.where("ID < 20"), "ID", "Period 0(s)", "Period 1(s)") == [(10, 3600.0, None), (11, None, 1800.0), (12, 0.0, None)]


def test_months_are_kept_apart(alarms):
    df = A.cascade(alarms([(1, "10:00", "12:00", 1001, 1, 1, "2024-01"), (1, "10:30", "11:00", 1001, 1, 1, "2024-02")]))
    assert rows(df, "period", "EffectiveAlarmTime") == [("2024-01", 7200.0), ("2024-02", 1800.0)]


def test_boundary_start_gets_an_empty_first_interval(alarms, at):
    df = A.to_intervals(A.cascade(alarms([(1, "10:10", "10:15", 1001, 1)])))
    assert rows(df, "TimeStamp", "EffectiveAlarmTime") == [(at("10:10"), 0.0), (at("10:20"), 300.0)]


@pytest.mark.parametrize(
    "blackouts, expected",
    [
        ([("10:30", "11:30")], [("10:00", "10:30")]),
        ([("10:20", "10:30")], [("10:00", "10:20"), ("10:30", "11:00")]),
        ([("09:00", "12:00")], []),
        ([("10:10", "10:30"), ("10:20", "10:40")], [("10:00", "10:10"), ("10:40", "11:00")]),
        ([("10:30", "10:30")], [("10:00", "10:30"), ("10:30", "11:00")]),
        ([("10:10", "10:20"), ("10:20", "10:30")], [("10:00", "10:10"), ("10:30", "11:00")]),
        ([("09:00", "10:00"), ("11:00", "12:00")], [("10:00", "11:00")]),
        ([], [("10:00", "11:00")]),
    ],
)
def test_subtract(alarms, at, blackouts, expected):
    log = alarms([(1, "10:00", "11:00", 1001, 1)] + [(10 + i, on, off, 1005, 1) for i, (on, off) in enumerate(blackouts)])
    # The alarm keeps its full time here: the subtraction is looked at alone.
    ready = log.withColumn("NewTimeOn", F.col("TimeOn")).withColumn(
        "EffectiveAlarmTime", F.lit(3600.0)
    ).withColumn("Period 0(s)", F.lit(None)).withColumn("Period 1(s)", F.lit(None))
    got = rows(A.subtract_alarms(ready).where("Alarmcode = 1001"), "TimeOn", "TimeOff")
    assert got == [(at(a), at(b)) for a, b in expected]


def test_subtract_keeps_the_code_itself_and_other_stations(alarms, at):
    log = alarms([(1, "10:00", "11:00", 1001, 1, 1), (2, "10:00", "11:00", 1001, 1, 2), (3, "10:20", "10:30", 1005, 1, 1)])
    out = A.subtract_alarms(A.cascade(log))
    assert rows(out, "ID", "StationNr", "TimeOn", "TimeOff") == [
        (1, 1, at("10:00"), at("10:20")), (1, 1, at("10:30"), at("11:00")), (2, 2, at("10:00"), at("11:00")), (3, 1, at("10:20"), at("10:30")),
    ]


def test_alarm_ending_before_its_start(alarms, at):
    """Bad data: kept when no single alarm of the code covers it, else removed."""
    log = alarms([(0, "08:00", "08:05", 1001, 1), (1, "10:10", "10:05", 1001, 1), (2, "12:10", "12:05", 1001, 1), (3, "12:00", "13:00", 1005, 1)])
    ready = log.withColumn("NewTimeOn", F.col("TimeOn")).withColumn("EffectiveAlarmTime", F.lit(300.0)).withColumn(
        "Period 0(s)", F.lit(None)
    ).withColumn("Period 1(s)", F.lit(None))
    assert rows(A.subtract_alarms(ready), "ID") == [(0,), (1,), (3,)]


def loop_cascade(log):
    out = {}
    for station in {r[4] for r in log}:
        reach = None
        for ident, on, off, _, _ in sorted((r for r in log if r[4] == station), key=lambda r: (r[1], r[0])):
            m = on if reach is None else reach
            start = off if off <= m else on if on >= m else m
            out[ident] = (start, abs((off - start).total_seconds()))
            reach = off if reach is None else max(reach, off)
    return out


def random_log(seed, n=300, stations=3):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1)
    log = []
    for i in range(n):
        on = base + timedelta(seconds=rng.randrange(0, 40) * 600 + rng.choice([0, 0, 7, 300]))
        off = on + timedelta(seconds=rng.choice([0, 60, 600, 5000, 40000]))
        # One station holds most of the log.
        log.append((i, on, off, rng.choice([1001, 1001, 1005]), 1 if rng.random() < 0.7 else rng.randrange(stations)))
    return log


@pytest.mark.parametrize("minutes", [1, 60, 60 * 24 * 400])
def test_cascade_against_a_loop(spark, minutes):
    log = random_log(minutes)
    df = spark.createDataFrame(
        [("p", i, on, off, st, code, 1) for i, on, off, code, st in log],
        "period string, ID long, TimeOn timestamp_ntz, TimeOff timestamp_ntz, StationNr long, Alarmcode int, `Error Type` int",
    )
    got = {r["ID"]: (r["NewTimeOn"], r["EffectiveAlarmTime"]) for r in A.cascade(df, timedelta(minutes=minutes)).collect()}
    assert got == loop_cascade(log)


def loop_subtract(log):
    """Cut one alarm after the other, following its overlapping alarms of the code in time order."""
    first = loop_cascade(log)
    out = []
    for ident, on, off, code, station in log:
        start, seconds = first[ident]
        if code == 1005:
            out.append((ident, on, off))
            continue
        if seconds <= 0:
            continue
        cuts = sorted((b_on, b_off) for _, b_on, b_off, c, s in log if c == 1005 and s == station and b_on < off and b_off > start)
        cursor = start
        for b_on, b_off in cuts:
            if cursor < b_on:
                out.append((ident, cursor, min(b_on, off)))
            cursor = max(cursor, b_off)
        if cursor < off:
            out.append((ident, cursor, off))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_subtract_against_a_loop(spark, seed):
    log = random_log(seed, 200)
    df = spark.createDataFrame(
        [("p", i, on, off, st, code, 1, on, off, "x") for i, on, off, code, st in log],
        "period string, ID long, TimeOn timestamp_ntz, TimeOff timestamp_ntz, StationNr long, Alarmcode int, `Error Type` int, "
        "OldTimeOn timestamp_ntz, OldTimeOff timestamp_ntz, `UK Text` string",
    )
    got = rows(A.subtract_alarms(A.cascade(df), width=timedelta(minutes=20 * seed)), "ID", "TimeOn", "TimeOff")
    assert got == loop_subtract(log)
    # After the second cascade no station has more alarm time in an interval than the interval holds.
    cells = A.alarm_by_interval(A.to_intervals(A.cascade(A.subtract_alarms(A.cascade(df))).where("EffectiveAlarmTime <> 0")))
    assert cells.agg(F.max("EffectiveAlarmTime")).first()[0] <= 600.0


def test_open_end_takes_first_whole_producing_interval(spark, alarms, at):
    log = alarms([(1, "10:05", None, 1001, 1), (2, "10:05", None, 7001, 9), (3, "10:25", None, 1001, 1), (4, "09:00", "09:30", 1001, 1)])
    flagged = log.withColumn(A.STOPPING, F.col("Alarmcode") == 1001)
    made = spark.createDataFrame(
        [("2024-01", 1, at(t)) for t in ("10:10", "10:20", "10:30")] + [("2024-01", 2, at("10:50"))],
        "period string, StationId long, TimeStamp timestamp_ntz",
    )
    out = A.impute_end_from_production(flagged, made)
    # 10:20 is the first stamp whose interval starts at or after 10:05.
    assert {r["ID"]: r["TimeOff"] for r in out.collect()} == {1: at("10:20"), 2: None, 3: None, 4: at("09:30")}


def test_open_end_in_a_later_block(spark, alarms, at):
    log = alarms([(1, "10:05", None, 1001, 1)]).withColumn(A.STOPPING, F.lit(True))
    later = at("10:00") + timedelta(days=9)
    made = spark.createDataFrame([("2024-01", 1, later)], "period string, StationId long, TimeStamp timestamp_ntz")
    assert A.impute_end_from_production(log, made).first()["TimeOff"] == later


def test_clamp_rules(spark, alarms, at):
    log = alarms(
        [
            (1, "08:00", None, 1001, 1),    # open and stopping: ends with the month, start raised
            (2, "07:00", "09:00", 1001, 1),  # over before the buffer: dropped
            (3, "15:00", "16:00", 1001, 1),  # starts after the end: dropped
            (4, "08:00", "11:00", 7001, 9),  # other code from before: dropped
            (5, "11:00", "18:00", 7001, 9),  # end capped
            (6, "11:00", None, 7001, 9),     # open and not stopping: stays open
        ]
    ).withColumn(A.STOPPING, F.col("Alarmcode") == 1001)
    bounds = spark.createDataFrame([("2024-01", at("10:00"), at("14:00"))], "period string, period_start timestamp_ntz, period_end timestamp_ntz")
    got = {r["ID"]: (r["TimeOn"], r["TimeOff"]) for r in A.clamp_alarms(log, bounds).collect()}
    assert got == {1: (at("09:50"), at("14:00")), 5: (at("11:00"), at("14:00")), 6: (at("11:00"), None)}


def test_running_max_on_one_hot_key(spark):
    """A key with all rows is cut into blocks; the result is that of a plain scan."""
    n = 5000
    df = spark.range(n).select(
        F.lit("k").alias("k"), "id",
        F.timestamp_add("SECOND", F.col("id") * 30, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("t"),
        F.pmod(F.col("id") * 7919, F.lit(1013)).alias("v"),
    )
    out = running_max_before(df, ["k"], ["t", "id"], "v", "top", timedelta(hours=1))
    expected, top = {}, None
    for i in range(n):
        expected[i] = top
        v = i * 7919 % 1013
        top = v if top is None else max(top, v)
    assert {r["id"]: r["top"] for r in out.select("id", "top").collect()} == expected


def test_first_fact_at_or_after_against_a_loop(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    # Facts repeat, leave whole days out, and one key has none; asks meet facts exactly and lack a key or a time.
    facts = [(k, start + timedelta(minutes=30 * rng.choice([*range(40), *range(200, 230)]))) for k in (1, 2) for _ in range(25)]
    facts = [*facts, *facts[:5], (1, None)]
    asks = [(n, rng.choice([1, 2, 3]), start + timedelta(minutes=30 * rng.randrange(260))) for n in range(120)]
    asks += [(200, None, start), (201, 1, None)]
    left = spark.createDataFrame(asks, "n long, k long, at timestamp_ntz")
    right = spark.createDataFrame(facts, "k long, made timestamp_ntz")
    got = {r["n"]: r["found"] for r in first_at_or_after(left, F.col("at"), right, "made", ["k"], "found").collect()}
    assert got == {n: min((t for key, t in facts if key == k and t and at and t >= at), default=None) for n, k, at in asks}
