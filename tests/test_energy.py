"""Counter gaps, operational turbines, potential energy and loss split."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gustledger.operators import energy as E
from gustledger.operators import losses as L

BASE = datetime(2024, 1, 1)


def series(spark, energy, counter, alarm=None, period="2024-01"):
    alarm = alarm or [0.0] * len(energy)
    return spark.createDataFrame(
        [(period, 1, BASE + timedelta(minutes=10 * i), e, c, a) for i, (e, c, a) in enumerate(zip(energy, counter, alarm))],
        "period string, StationId long, TimeStamp timestamp_ntz, wtc_kWG1TotE_accum double, wtc_kWG1TotE_endvalue double, EffectiveAlarmTime double",
    )


@pytest.mark.parametrize(
    "energy, counter, alarm, expected",
    [
        ([10.0, None, None, 20.0], [100.0, None, None, 160.0], None, [10.0, 20.0, 20.0, 20.0]),
        ([10.0, None, None, 20.0], [100.0, None, None, 160.0], [0, 0, 600, 0], [10.0, 40.0, 0.0, 20.0]),
        ([10.0, None, 20.0], [100.0, None, 50.0], None, [10.0, None, 20.0]),
        ([None, None, 20.0], [None, None, 160.0], None, [None, None, 20.0]),
        ([10.0, None], [100.0, None], None, [10.0, None]),
        ([10.0, None, 20.0], [100.0, None, 100.0], None, [10.0, 0.0, 20.0]),
        ([10.0, None, 20.0], [100.0, None, 110.0], None, [10.0, 0.0, 20.0]),
        ([10.0, None, 20.0], [100.0, None, 1100.0], None, [10.0, None, 20.0]),
        ([10.0, None, 20.0], [None, None, 160.0], None, [10.0, None, 20.0]),
        ([10.0, None, 20.0], [100.0, None, 160.0], [0, 600, 0], [10.0, 0.0, 20.0]),
        ([10.0, None, None, None, 5.0], [100.0, None, None, None, 205.0], [0, 0, None, 0, 0], [10.0, 33.33, 33.33, 33.33, 5.0]),
    ],
)
def test_gap_cases(spark, energy, counter, alarm, expected):
    alarm = None if alarm is None else [None if a is None else float(a) for a in alarm]
    out = E.impute_energy(series(spark, energy, counter, alarm)).orderBy("TimeStamp").collect()
    assert [r["wtc_kWG1TotE_accum"] for r in out] == expected


def test_source_marks_only_spread_rows(spark):
    out = E.impute_energy(series(spark, [10.0, None, None, 20.0], [100.0, None, None, 160.0], [0.0, 0.0, 600.0, 0.0]))
    assert [r["Energy_Source"] for r in out.orderBy("TimeStamp").collect()] == ["actual", "interpolated", "actual", "actual"]


def test_without_counter_nothing_happens(spark):
    df = series(spark, [1.0, None], [1.0, 2.0]).drop("wtc_kWG1TotE_endvalue")
    assert E.impute_energy(df).where("wtc_kWG1TotE_accum IS NULL").count() == 1


def test_gaps_do_not_cross_months(spark):
    a = series(spark, [10.0, None], [100.0, None], period="2024-01")
    b = series(spark, [20.0], [160.0], period="2024-02")
    assert E.impute_energy(a.unionByName(b)).where("wtc_kWG1TotE_accum IS NULL").count() == 1


def cell(**values):
    base = dict(Energy_To_Use=50.0, EffectiveAlarmTime=0.0, wtc_ScInOper_timeon=600.0, duration=0.0, wtc_PowerRed_timeon=0.0, wtc_ActPower_max=1000.0)
    return {**base, **values}


@pytest.mark.parametrize(
    "values, expected",
    [
        ({}, True),
        ({"wtc_PowerRed_timeon": None, "wtc_ActPower_max": 2300.0}, True),
        ({"wtc_PowerRed_timeon": None}, False),
        ({"wtc_PowerRed_timeon": 100.0}, False),
        ({"wtc_PowerRed_timeon": 100.0, "wtc_ActPower_max": 2300.0}, True),
        ({"Energy_To_Use": None}, False),
        ({"EffectiveAlarmTime": 1.0}, False),
        ({"duration": 5.0}, False),
        ({"wtc_ScInOper_timeon": None}, False),
    ],
)
def test_operational(spark, values, expected):
    row = cell(**values)
    schema = ", ".join(f"{k} double" for k in row)
    df = spark.createDataFrame([tuple(row.values())], schema).withColumnRenamed("duration", "Duration 2006(s)")
    assert df.select(E.operational()).first()[0] is expected


def test_curve_is_extended_at_both_ends_and_knots_may_be_apart(spark):
    curve = spark.createDataFrame([(3, 0), (5, 100), (6, 200), (10, 200)], "Wind int, Power int")
    winds = [2.0, 3.0, 4.0, 5.5, 6.0, 9.0, 12.0, None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(winds)], "i int, w double")
    got = [r["p"] for r in E.curve_power(df, curve, "w", "p").orderBy("i").collect()]
    assert got == [-50.0, 0.0, 50.0, 150.0, 200.0, 200.0, 200.0, None]


def test_curve_with_two_powers_for_one_wind_is_refused(spark):
    curve = spark.createDataFrame([(3, 0), (3, 5), (5, 100)], "Wind int, Power int")
    with pytest.raises(Exception, match="two powers"):
        E.curve_power(spark.createDataFrame([(4.0,)], "w double"), curve, "w", "p").collect()


def test_curve_knots_may_stand_between_whole_speeds(spark):
    curve = spark.createDataFrame([(3.0, 0.0), (3.5, 100.0), (3.75, 50.0), (5.25, 200.0), (3.5, 100.0)], "Wind double, Power double")
    winds = [2.5, 3.25, 3.5, 3.625, 3.75, 4.5, 5.25, 6.0, None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(winds)], "i int, w double")
    got = [r["p"] for r in E.curve_power(df, curve, "w", "p").orderBy("i").collect()]
    assert got == [-100.0, 50.0, 100.0, 75.0, 50.0, 125.0, 200.0, 275.0, None]


def test_curve_with_an_absurd_wind_is_refused(spark):
    curve = spark.createDataFrame([(3.0, 0.0), (2e9, 100.0)], "Wind double, Power double")
    with pytest.raises(Exception, match="beyond 200"):
        E.curve_power(spark.createDataFrame([(4.0,)], "w double"), curve, "w", "p").collect()


def test_correction_factor(spark):
    f = spark.range(1).select(E.correction_factor(F.lit(131)), E.correction_factor(F.lit(1))).first()
    assert f[0] == pytest.approx(1.0) and f[1] == pytest.approx(0.92)


def test_method_order(spark):
    """Running, average of the running, own energy above it, wind, season."""
    data = [
        # stamp 0: station 1 runs with 60, station 2 stopped, station 3 stopped but made 90
        (0, 1, 60.0, 0.0, 8.0), (0, 2, None, 600.0, 8.0), (0, 3, 90.0, 600.0, 8.0),
        # stamp 1: nobody runs; wind known, then unknown
        (1, 1, None, 600.0, 5.0), (1, 2, 7.0, 600.0, None), (1, 3, None, 600.0, None),
    ]
    df = spark.createDataFrame(
        [("2024-01", s, BASE + timedelta(minutes=10 * t), e, a, w, 600.0, 0.0, 0.0, 1000.0) for t, s, e, a, w in data],
        "period string, StationId long, TimeStamp timestamp_ntz, Energy_To_Use double, EffectiveAlarmTime double, wtc_AcWindSp_mean double, "
        "wtc_ScInOper_timeon double, `Duration 2006(s)` double, wtc_PowerRed_timeon double, wtc_ActPower_max double",
    )
    curve = spark.createDataFrame([(0, 0), (10, 600)], "Wind int, Power int")
    stat = spark.createDataFrame([(1, 4.5)], "month int, statistical_energy double")
    out = {(r["TimeStamp"].minute, r["StationId"]): (r["Epot"], r["Epot_Method"]) for r in E.potential_cascade(df, curve, stat).collect()}
    assert out == {
        (0, 1): (60.0, E.PRODUCED), (0, 2): (55.2, E.AVERAGE), (0, 3): (90.0, E.PRODUCED),
        (10, 1): (50.0, E.ANEMOMETER), (10, 2): (7.0, E.STATISTICS), (10, 3): (4.5, E.STATISTICS),
    }


def test_power_source_clips_negatives_and_keeps_missing(spark):
    df = spark.createDataFrame([(600.0,), (-5.0,), (None,)], "wtc_ActPower_mean double")
    assert [r[0] for r in df.select(E.energy_to_use("power")).collect()] == [100.0, 0.0, None]


def test_loss_split_adds_up(spark):
    df = spark.createDataFrame(
        [(100.0, 40.0, 200.0, 400.0, 0.0, None, None), (100.0, 40.0, 0.0, 0.0, 5.0, None, None), (100.0, 40.0, 0.0, 0.0, 5.0, 60.0, 2350.0), (None, 40.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
        "Epot double, Energy_To_Use double, `Period 0(s)` double, `Period 1(s)` double, `Duration 2006(s)` double, wtc_PowerRed_timeon double, wtc_ActPower_max double",
    )
    got = [(r["EL"], r["ELX"], r["ELNX"], r["EL_PowerRed"], r["EL_2006"], r["EL_indefini"]) for r in L.split_losses(df).collect()]
    assert got == [(60.0, 20.0, 40.0, 0.0, 0.0, 0.0), (60.0, 0.0, 0.0, 0.0, 60.0, 0.0), (60.0, 0.0, 0.0, 60.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def test_wind_patterns(spark):
    """Low wind, then the start after it (also without loss), then the start after an alarm."""
    rest = [10.0, 0.0, 5.0, 7.0]
    alarm = [0.0, 0.0, 600.0, 0.0]
    # The third and fourth rows are a local problem: neighbours produce with more wind.
    data = [
        ("2024-01", 1, BASE + timedelta(minutes=10 * i), r, a, 6.0, *((8.0, 8.0, 2.0, 2.0, 50.0, 50.0) if i >= 2 else (0.0,) * 6))
        for i, (r, a) in enumerate(zip(rest, alarm))
    ]
    names = "wind_speed_prev_turbine wind_speed_next_turbine wind_speed_diff_prev_turbine wind_speed_diff_next_turbine min_power_prev_turbine min_power_next_turbine"
    df = spark.createDataFrame(
        data,
        "period string, StationId long, TimeStamp timestamp_ntz, EL_indefini double, EffectiveAlarmTime double, wtc_AcWindSp_mean double, "
        + ", ".join(f"{n} double" for n in names.split()),
    ).withColumn("alarm_period_prev_turbine", F.lit(0.0)).withColumn("alarm_period_next_turbine", F.lit(0.0))
    got = [(r["EL_wind"], r["EL_wind_start"], r["EL_alarm_start"], r["EL_indefini_left"]) for r in L.wind_patterns(df).orderBy("TimeStamp").collect()]
    assert got == [(10.0, None, None, 0.0), (None, 0.0, None, 0.0), (None, None, None, 5.0), (None, None, 7.0, 0.0)]
