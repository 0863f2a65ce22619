"""Files in the reference layout, stored months, and the whole month."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg
from gustledger.operators import kpi as K
from gustledger.plans import monthly
from gustledger.plans.weekly import process_week, weekly
from gustledger.sources import extracts, readers, writers


def put(root, kind, period, text):
    folder = root / kind.upper()
    folder.mkdir(exist_ok=True)
    (folder / f"{period}-{kind}.csv").write_text(text)


def test_signal_files_by_month_and_column_order(spark, tmp_path):
    put(tmp_path, "din", "2024-01", "wtc_PowerRed_timeon,TimeStamp,StationId\n5.0,2024-01-01 00:10:00,7\n,2024-01-01 00:20:00,7\n")
    put(tmp_path, "din", "2024-02", "wtc_PowerRed_timeon,TimeStamp,StationId\n6.0,2024-02-01 00:10:00,8\n")
    one = readers.load_signal(readers.read_signal(spark, str(tmp_path), "din", ["2024-01"]), "din").orderBy("TimeStamp").collect()
    assert [(r["period"], r["StationId"], r["TimeStamp"], r["wtc_PowerRed_timeon"]) for r in one] == [
        ("2024-01", 7, datetime(2024, 1, 1, 0, 10), 5.0), ("2024-01", 7, datetime(2024, 1, 1, 0, 20), None),
    ]
    assert readers.read_signal(spark, str(tmp_path), "din").select("period").distinct().count() == 2
    with pytest.raises(AnalysisException):
        readers.read_signal(spark, str(tmp_path), "din", ["2024-03"]).collect()


def test_alarm_file(spark, tmp_path):
    put(
        tmp_path, "sum", "2024-01",
        "ID,TimeOn,TimeOff,StationNr,Alarmcode,Parameter\n"
        '1,2024-01-01 00:00:01.250000,2024-01-01 00:10:00,2307405,1001.0,"a ""b"" c"\n'
        "2,2024-01-01 00:00:02,,2307405,1001.0,\n"
        "3,2024-01-01 00:00:02,soon,2307405,,x\n"
        "4,2024-01-01 00:00:02,,2307536,1001.0,x\n",
    )
    got = [tuple(r) for r in readers.load_alarms(readers.read_signal(spark, str(tmp_path), "sum")).orderBy("ID").collect()]
    assert got == [
        (1, datetime(2024, 1, 1, 0, 0, 1, 250000), datetime(2024, 1, 1, 0, 10), 2307405, 1001, 'a"b"c', "2024-01"),
        (2, datetime(2024, 1, 1, 0, 0, 2), None, 2307405, 1001, None, "2024-01"),
    ]


def test_times_are_read_as_written_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Africa/Casablanca")
        text = "2025-04-06 02:30:00"  # the clock jumps over this hour there
        row = spark.createDataFrame([(text,)], "t string").select(
            tg.parse_time(F.col("t")).cast("string").alias("a"), tg.iso(tg.parse_time(F.col("t"))).alias("b")
        ).first()
        assert tuple(row) == (text, "2025-04-06T02:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_correction_document(spark, tmp_path):
    entries = [{"id": 5, "alarm_code": 1, "station_nr": 2, "time_on": "2024-01-01 00:00:00", "notes": "a"}, {"id": 5, "time_off": "2024-01-02 00:00:00"}]
    path = tmp_path / "adjustments.json"
    path.write_text(json.dumps({"adjustments": entries}, indent=2))
    got = [(r["pos"], r["id"], r["time_on"], r["time_off"]) for r in readers.read_adjustments(spark, str(path)).collect()]
    assert got == [(0, 5, "2024-01-01 00:00:00", None), (1, 5, None, "2024-01-02 00:00:00")]


def test_rewriting_a_month_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "res")
    writers.write_partitioned(spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "period string, v int"), path)
    writers.write_partitioned(spark.createDataFrame([("2024-02", 3)], "period string, v int"), path)
    assert sorted(r["v"] for r in readers.read_results(spark, path).collect()) == [1, 3]
    assert [r["v"] for r in readers.read_results(spark, path, ["2024-02"]).collect()] == [3]


def test_month_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "res")
    writers.write_partitioned(spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "period string, v int"), path)
    plan = readers.read_results(spark, path, ["2024-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan or "PartitionFilters: [(period" in plan


def test_extract_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "sig")
    spark.createDataFrame([(datetime(2024, 1, 1), 1, 2.0, 3.0)], "TimeStamp timestamp_ntz, StationId long, wtc_PowerRed_timeon double, other double").write.parquet(path)
    df = extracts.signal_extract(spark.read.parquet(path), "din", "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(TimeStamp" in plan and "LessThan(TimeStamp" in plan and "other" not in plan.split("ReadSchema")[1]


def test_open_alarm_in_extract_needs_a_stopping_code(spark):
    day = datetime(2024, 1, 5)
    al = spark.createDataFrame(
        [(1, datetime(2023, 12, 1), None, 1, 1001, ""), (2, datetime(2023, 12, 1), None, 1, 7001, ""), (3, day, None, 1, 7001, ""), (4, day, day, 1, 50100, "")],
        "ID long, TimeOn timestamp_ntz, TimeOff timestamp_ntz, StationNr long, Alarmcode int, Parameter string",
    )
    codes = spark.createDataFrame([(1001,)], "Alarmcode int")
    got = extracts.alarm_extract(al, codes, "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    assert sorted(r["ID"] for r in got.collect()) == [1, 3]


def test_circular_mean_wraps_and_is_zero_without_data(spark):
    df = spark.createDataFrame([(350.0, None), (10.0, None)], "met_WinddirectionRot_mean_38 double, met_WinddirectionRot_mean_39 double")
    one = K.mean_direction(df.select("met_WinddirectionRot_mean_38"), (38,)).first()[0]
    assert min(one, 360 - one) == pytest.approx(0.0, abs=1e-9)
    assert K.mean_direction(df.select("met_WinddirectionRot_mean_39"), (39,)).first()[0] == 0.0


def test_reports_of_days_are_those_of_stamps(spark):
    """Days carry their midnight, so a range of days takes whole days and no others."""
    names = K.WEEKLY_SUMS + ["met_WindSpeedRot_mean_38", "met_WinddirectionRot_mean_38"]
    stamps = [datetime(2024, 1, 31, 23, 50), datetime(2024, 2, 1), datetime(2024, 2, 1, 23, 50), datetime(2024, 2, 2, 12), datetime(2024, 2, 3), None]
    rows = [
        (t and f"{t:%Y-%m}", s, t, *[None if (i + s + k) % 5 == 4 else float(100 * i + 7 * k + s) for k in range(len(names))])
        for i, t in enumerate(stamps) for s in (1, 2, 2)
    ]
    res = spark.createDataFrame(rows, "period string, StationId long, TimeStamp timestamp_ntz, " + ", ".join(f"`{n}` double" for n in names))
    days, week = K.daily_partials(res, (38,)), ("2024-02-01 00:00:00", "2024-02-02 23:50:00")
    found = {(r["StationId"], r["TimeStamp"]) for r in days.collect()}
    assert found == {(s, t and t.replace(hour=0, minute=0)) for t in stamps for s in (1, 2)}
    assert K.weekly_kpi_of_days(days, *week, masts=(38,)).first().asDict() == pytest.approx(K.weekly_kpi(res, *week, masts=(38,)).first().asDict())
    assert K.top_loss(days, *week, first_station=1).collect() == K.top_loss(res, *week, first_station=1).collect()


# ------------------------------------------------------------------ the month

STEP = timedelta(hours=6)


def farm(spark, periods, stations=4):
    """A small farm on a six-hour grid: gaps, alarms over the month end, open ends, curtailment."""
    sig, log = {k: [] for k in ("cnt", "grd", "tur", "din", "flg", "met")}, []
    ident = 0
    for period in periods:
        start = datetime.fromisoformat(f"{period}-01")
        for i in range(24):
            t = start + STEP * i
            sig["met"].append((period, t, 5.0 + i % 3))
            for s in range(1, stations + 1):
                x = (i * 7 + s * 3) % 11
                made = float(20 + 5 * x)
                sig["cnt"].append((period, s, t, made, None if x == 4 else made, 1000.0 * s + 60.0 * i))
                sig["grd"].append((period, s, t, float(x * 100 - 200), float(x * 250), float(x * 150)))
                sig["tur"].append((period, s, t, None if x == 6 else 3.0 + x, 180.0))
                sig["din"].append((period, s, t, 300.0 if x == 9 else 0.0))
                sig["flg"].append((period, s, t, 600.0))
        for s, code, on, hours in ((1, 1001, -9, 40), (2, 3203, 30, 5), (2, 1005, 32, 1), (3, 1001, 60, None), (3, 2006, 20, 12), (4, 3203, 100, 400), (1, 7001, 5, 2)):
            ident += 1
            t = start + timedelta(hours=on)
            log.append((period, ident, t, None if hours is None else t + timedelta(hours=hours), s, code, ""))
    key = "period string, StationId long, TimeStamp timestamp_ntz, "
    make = spark.createDataFrame
    return {
        "cnt": make(sig["cnt"], key + "wtc_kWG1Tot_accum double, wtc_kWG1TotE_accum double, wtc_kWG1TotE_endvalue double"),
        "grd": make(sig["grd"], key + "wtc_ActPower_min double, wtc_ActPower_max double, wtc_ActPower_mean double"),
        "tur": make(sig["tur"], key + "wtc_AcWindSp_mean double, wtc_ActualWindDirection_mean double"),
        "din": make(sig["din"], key + "wtc_PowerRed_timeon double"),
        "flg": make(sig["flg"], key + "wtc_ScInOper_timeon double"),
        "met": make(sig["met"], "period string, TimeStamp timestamp_ntz, met_WindSpeedRot_mean_38 double"),
        "sum": make(log, "period string, ID long, TimeOn timestamp_ntz, TimeOff timestamp_ntz, StationNr long, Alarmcode int, Parameter string"),
    }


def lookups(spark):
    codes = spark.createDataFrame([(1001, 1, "pitch"), (3203, 0, "low wind"), (1005, 1, "service")], "Alarmcode int, `Error Type` int, `UK Text` string")
    curve = spark.createDataFrame([(0, 0), (10, 600), (15, 900)], "Wind int, Power int")
    bins = spark.createDataFrame([(b, 300.0) for b in range(1, 26)], "bin int, value double")
    season = spark.createDataFrame([(m, 1.0) for m in range(1, 13)], "month int, value double")
    stations = spark.range(1, 5).withColumnRenamed("id", "StationId")
    return {"codes": codes, "curve": curve, "distribution": bins, "season": season, "stations": stations}


def run_month(spark, periods, **settings):
    return monthly.full_calculation(farm(spark, periods), settings=monthly.Settings(step=STEP, turbines=4, **settings), **lookups(spark))


def test_two_months_at_once_equal_two_runs(spark):
    both = run_month(spark, ["2024-02", "2024-03"])
    assert both.count() == 2 * 4 * 24
    apart = run_month(spark, ["2024-02"]).unionByName(run_month(spark, ["2024-03"]))
    order = ["period", "StationId", "TimeStamp"]
    drop = [c for c in both.columns if c in ("UK Text",)]
    a, b = (sorted(map(tuple, df.drop(*drop).select(*sorted(set(df.columns) - set(drop))).collect()), key=repr) for df in (both, apart))
    assert a == b
    assert both.groupBy(*order).count().where("count > 1").count() == 0


def test_loss_identity_and_invariants(spark):
    res = run_month(spark, ["2024-02"])
    off = res.where(
        F.abs(F.col("EL") - (F.col("ELX") + F.col("ELNX") + F.col("EL_PowerRed") + F.col("EL_2006") + F.col("EL_indefini"))) > 0.03
    )
    assert off.count() == 0
    assert res.where("EffectiveAlarmTime > 21600").count() == 0
    assert res.where("EL < 0").count() == 0
    assert res.where("Epot IS NULL").count() == 0
    # The open alarm of station 3 ended at the first interval that began after it and produced.
    assert res.where("StationId = 3 AND EffectiveAlarmTime > 0").count() < 5


def test_store_and_weekly_report(spark, tmp_path):
    path = str(tmp_path / "res")
    writers.write_partitioned(run_month(spark, ["2024-02"]), path)
    report, top = weekly(spark, path, ["2024-02"], "2024-02-01 00:00:00", "2024-02-07 23:50:00", 4, (38,), first_station=1)
    row = report.first().asDict()
    assert "Maker downtime, energy (%)" in row and row["Mean mast wind (m/s)"] == "6.00"
    assert [r["StationId"] for r in top.collect()] and top.count() <= 15


def test_power_source_and_farm_wide_warning(spark):
    a = run_month(spark, ["2024-02"], source="power", warning_per_station=False)
    assert a.where("Energy_To_Use < 0").count() == 0
    assert a.where("`Duration 2006(s)` > 0").select("StationId").distinct().count() == 1


LISTED = "pos long, id long, alarm_code long, station_nr long, time_on string, time_off string, notes string, last_updated string"


def test_week_over_two_months_from_signals_to_report(spark, tmp_path):
    """Alarm 4 of each month has no end. Production ends it; the list has the end, and a second run needs it no more."""
    path, settings = str(tmp_path / "res"), monthly.Settings(step=STEP, turbines=4)
    old = spark.createDataFrame([(0, 1, 1001, 1, None, "2024-02-01 10:00:00", "Auto-imputed from production data", "x"), (1, 2, 3203, 2, None, "2024-02-02 08:00:00", "by hand", "x")], LISTED)

    def run(listed):
        return process_week(
            spark, lambda periods: farm(spark, periods), lookups(spark), path, "2024-02-26 00:00:00", "2024-03-03 23:50:00", "now", listed,
            settings, first_station=1, masts=(38,),
        )

    done = run(old)
    assert sorted(r["period"] for r in spark.read.parquet(path).select("period").distinct().collect()) == ["2024-02", "2024-03"]
    assert done.grouped.count() == 2 * 4 and done.report.count() == 1 and done.top.count() == 4
    listed = {r["id"]: r for r in done.adjustments.collect()}
    # The automatic end of an alarm that has one is gone, what was set by hand stays, open ends are new.
    assert sorted(listed) == [2, 4, 11] and listed[2]["notes"] == "by hand" and listed[2]["last_updated"] == "x"
    produced = farm(spark, ["2024-02"])["cnt"].where("StationId = 3 AND wtc_kWG1TotE_accum > 0 AND TimeStamp >= TIMESTAMP_NTZ '2024-02-03 18:00:00'").agg(F.min("TimeStamp")).first()[0]
    assert listed[4]["time_off"] == str(produced) and listed[4]["last_updated"] == "now"
    assert done.left_open.count() == 0
    first = sorted(map(str, spark.read.parquet(path).drop("UK Text").collect()))
    again = run(done.adjustments)
    assert sorted(map(tuple, again.adjustments.collect())) == sorted(map(tuple, done.adjustments.collect()))
    assert sorted(map(str, spark.read.parquet(path).drop("UK Text").collect())) == first


def test_a_week_stores_its_results_without_moving_or_sorting_them(spark, tmp_path, monkeypatch):
    """The rows are stored where the losses were made; the plan of the write has no shuffle or sort above its windows."""
    plans, write = [], writers.write_partitioned

    def seen(df, path, *args, **choice):
        if not path.endswith("res"):
            return write(df, path, *args, **choice)
        rows = df.hint("rebalance", "period") if choice.get("rebalance", True) else df
        plans.append(rows.sortWithinPartitions("period")._jdf.queryExecution().executedPlan().toString())
        return write(df, path, *args, **choice)

    monkeypatch.setattr(writers, "write_partitioned", seen)
    path = str(tmp_path / "res")
    process_week(
        spark, lambda periods: farm(spark, periods), lookups(spark), path, "2024-02-26 00:00:00", "2024-03-03 23:50:00", "now", spark.createDataFrame([], LISTED),
        monthly.Settings(step=STEP, turbines=4), first_station=1, masts=(38,),
    )
    above = plans[0][: plans[0].index("Window [")]
    assert len(plans) == 1 and "Exchange hash" not in above and "REBALANCE" not in above and "Sort [" not in above
    got = spark.read.parquet(path)
    assert got.count() == 2 * 4 * 24 and got.where("met_WindSpeedRot_mean_38 IS NULL").count() == 0


def test_what_a_calculation_says_of_open_alarms(spark):
    done = monthly.calculate(farm(spark, ["2024-02"]), settings=monthly.Settings(step=STEP, turbines=4), **lookups(spark))
    assert [r["id"] for r in done.imputed.collect()] == [4] and done.left_open.count() == 0
    assert [(r["period"], r["warning_date"]) for r in done.warning_date.collect()] == [("2024-02", datetime(2024, 1, 31, 15))]
    still = farm(spark, ["2024-02"])
    still = {**still, "cnt": still["cnt"].where("StationId <> 3 OR TimeStamp < TIMESTAMP_NTZ '2024-02-02 00:00:00'")}
    done = monthly.calculate(still, settings=monthly.Settings(step=STEP, turbines=4), **lookups(spark))
    assert done.imputed.count() == 0 and [r["ID"] for r in done.left_open.collect()] == [4]


def test_stored_months_are_compressed_and_cells_made_once(spark, tmp_path, monkeypatch):
    """The checked months come from one table of cells, and their files are read back as they were."""
    from checks import source_queries, views

    day = datetime(1995, 1, 5)
    spark.createDataFrame(
        [(i, 1, 1 + i % 3, 1 + i % 2, float(i), 10.25 * i, 0.01 * (i % 9), 0.02, "ANR"[i % 3], "O", day + timedelta(days=i % 40)) for i in range(200)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(
        [(i, day, i % 4, "error", 1.0, "{}") for i in range(50)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ).write.parquet(str(tmp_path / "events.parquet"))
    root, made, cell = str(tmp_path / "months"), [], views.v_cell
    monkeypatch.setattr(source_queries, "fresh_folder", lambda spark: root)
    monkeypatch.setattr(views, "v_cell", lambda *args: made.append(1) or cell(*args))
    counts = {r["kind"]: (r["row_count"], r["stations"]) for r in source_queries.load_all(spark, str(tmp_path)).collect()}
    cells = cell(spark, str(tmp_path)).count()
    assert len(made) == 1 and counts["sum"] == (47, 4)
    assert all(counts[k] == (cells, 3) for k in ("grd", "cnt", "tur", "din", "flg"))
    for kind in ("grd", "cnt", "tur", "din", "flg", "sum", "met"):
        files = [f.name for f in (tmp_path / "months" / kind.upper() / f"2024-01-{kind}.csv").iterdir() if f.name.startswith("part-")]
        assert files and all(n.endswith(".csv.gz") for n in files)
