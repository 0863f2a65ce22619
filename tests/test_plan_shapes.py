"""The physical plans keep the properties the library promises at scale."""

import re
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg
from gustledger.operators import alarms as A
from gustledger.operators import energy as E
from gustledger.operators import grid as G
from gustledger.operators import losses as L
from gustledger.operators import quality as Q
from gustledger.operators import tiles as T
from gustledger.operators.blocks import first_at_or_after
from gustledger.plans import monthly
from gustledger.plans.settle import settle
from gustledger.sources import journal as J
from gustledger.sources import writers


def month():
    """The month of a row; not a literal, which Spark would drop from the keys."""
    return F.when(F.col("id") >= 0, "2024-01").otherwise("2024-02").alias("period")


@pytest.fixture
def large(spark):
    """Spark plans as for tables too large to broadcast, unless told otherwise."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield spark
    for n, value in old.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan(df))


def windows(df):
    """Partition and order of every window over rows of a table."""
    return re.findall(r"Window \[(.*?) windowspecdefinition\((.*?), specifiedwindowframe", plan(df))


def log(spark):
    return spark.range(1000).select(
        month(), F.col("id").alias("ID"), (F.col("id") % 7).alias("StationNr"),
        F.timestamp_add("MINUTE", F.col("id"), tg.ntz("2024-01-01 00:00:00")).alias("TimeOn"),
        F.timestamp_add("MINUTE", F.col("id") + 5, tg.ntz("2024-01-01 00:00:00")).alias("TimeOff"),
        F.lit(1).alias("Error Type"), F.when(F.col("id") % 5 == 0, 1005).otherwise(1001).alias("Alarmcode"), F.lit("x").alias("UK Text"),
    ).withColumn("OldTimeOn", F.col("TimeOn"))


def test_alarms_of_a_station_are_only_windowed_in_blocks(large):
    df = A.cascade(log(large))
    over_rows = [spec for name, spec in windows(df) if "TimeOff" in name]
    assert over_rows and all("_block" in spec for spec in over_rows)
    # The rows are shuffled by block; only the block table is gathered by station.
    assert [e for e in exchanges(df) if "_block" not in e] == ["period, StationNr"]
    assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_subtraction_pairs_no_rows(large):
    df = A.subtract_alarms(settle(A.cascade(log(large))))
    joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[(.*?)\]", plan(df))
    assert joins and all("_block" in keys for keys in joins)
    assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


SIGNALS = ["wtc_kWG1TotE_accum", "EffectiveAlarmTime", "Period 0(s)", "Period 1(s)", "Duration 2006(s)", "wtc_AcWindSp_mean",
           "wtc_ActPower_min", "wtc_ActPower_max", "wtc_ActPower_mean", "wtc_PowerRed_timeon", "wtc_ScInOper_timeon"]


def cells(spark, stations, stamps):
    """Cells of a month with the blocks of their stations, and the array of all blocks."""
    placed = T.station_blocks(spark.range(stations).select((F.col("id") * 3).alias("StationId")))
    grid = placed.join(spark.range(stamps), how="cross").withColumn("TimeStamp", F.timestamp_add("MINUTE", F.col("id") * 10, tg.ntz("2024-01-01 00:00:00")))
    spread = F.pmod(F.xxhash64("StationId", "id"), F.lit(50)).cast("double")
    rows = grid.select(month(), "StationId", "TimeStamp", T.BLOCKS, F.lit("x").alias("UK Text"), *[(spread + i).alias(c) for i, c in enumerate(SIGNALS)])
    return rows, F.sequence(F.lit(0), F.lit((stations - 1) // T.STATIONS))


def curve_and_stat(spark):
    return spark.createDataFrame([(0, 0), (10, 600)], "Wind int, Power int"), spark.createDataFrame([(1, 4.5)], "month int, statistical_energy double")


def test_loss_accounting_shuffles_the_wide_frame_once_and_by_station(large):
    rows, blocks = cells(large, 40, 100)
    df = monthly.assess(settle(rows), blocks, *curve_and_stat(large))
    # Only the averages of the stamps, one row per stamp and task, are shuffled without the station.
    assert sorted(exchanges(df)) == ["period, TimeStamp", "period, _station_block, _time_block"]
    assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


@pytest.mark.parametrize("stations", [5, 20, 2000])
def test_tiles_do_not_grow_with_the_farm(spark, stations):
    rows, blocks = cells(spark, stations, 80)
    stamps = rows.groupBy("period", "TimeStamp").agg(F.count("*").alias("_count"))
    tiles = T.tiled(rows, stamps, blocks, timedelta(minutes=10), monthly.MARGIN)
    sizes = tiles.groupBy(*T.TILE).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= (T.STATIONS + 2 + 1) * 37
    inner = T.inner_cells(tiles.where("StationId IS NOT NULL"))
    assert inner.count() == stations * 80 and inner.select("StationId", "TimeStamp").distinct().count() == stations * 80


def test_tiles_give_what_one_window_gives(spark):
    """Neighbours, averages over the stamp and the look back, against windows over whole stamps and whole months."""
    rows, blocks = cells(spark, 37, 90)
    rows = settle(rows.where("NOT (StationId = 48 AND TimeStamp > TIMESTAMP_NTZ '2024-01-01 05:00:00')").unionByName(
        rows.where("StationId = 48 AND TimeStamp > TIMESTAMP_NTZ '2024-01-01 05:00:00'").withColumns({c: F.lit(None).cast("double") for c in SIGNALS})
    ))
    curve, stat = curve_and_stat(spark)
    got = monthly.assess(rows, blocks, curve, stat)
    plain = L.neighbour_values(rows.drop(T.BLOCKS).withColumn("Energy_To_Use", E.energy_to_use()))
    plain = L.misassigned(L.wind_patterns(L.split_losses(E.potential_cascade(plain, curve, stat))))
    columns = sorted(plain.columns)
    assert sorted(got.columns) == columns

    def rounded(df):
        kinds = dict(df.dtypes)
        return df.select(*[F.round(f"`{c}`", 6).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in columns])

    assert rounded(got).exceptAll(rounded(plain)).isEmpty() and rounded(plain).exceptAll(rounded(got)).isEmpty()
    assert got.where("EL_wind > 0").count() > 0 and got.where("wind_speed_prev_turbine IS NULL").count() > 0


def test_stopped_time_shuffles_two_rows_per_alarm(large, tmp_path):
    path = str(tmp_path / "alarms")
    long = F.timestamp_add("DAY", F.lit(20), F.col("TimeOn"))
    log(large).where("ID < 7").withColumns({"TimeOff": long, "NewTimeOn": F.col("TimeOn"), "EffectiveAlarmTime": F.lit(20 * 86400.0)}).write.parquet(path)
    df = A.stopped_by_interval(large.read.parquet(path))
    assert exchanges(df) == ["period, StationNr, TimeStamp"]
    below = plan(df).split("Exchange hashpartitioning", 1)[1]
    assert "explode" in below and "inline" not in below
    rows = df.collect()
    assert len(rows) == 7 * (20 * 144 + 1) and sum(r["EffectiveAlarmTime"] for r in rows) == 7 * 20 * 86400


def test_presence_is_one_bitmap_per_group(large):
    met = large.range(1000).select(month(), (F.col("id") % 3).alias("StationId"), F.timestamp_add("MINUTE", F.col("id") * 10, tg.ntz("2024-01-01 00:00:00")).alias("TimeStamp"))
    ranges = large.createDataFrame([("2024-01",)], "period string").select("period", tg.ntz("2024-01-01 00:00:00").alias("range_start"), tg.ntz("2024-01-08 00:00:00").alias("range_end"))
    for by, key in (((), "period"), (("StationId",), "period, StationId")):
        for df in (Q.completeness(met, ranges, by=by), Q.missing_timestamps(met, ranges, by=by)):
            # The other exchange joins the groups with the few rows of the ranges.
            assert set(exchanges(df)) <= {key, "period"} and "count(distinct" not in plan(df)


def test_imputation_shuffles_once(large, tmp_path):
    path = str(tmp_path / "cells")
    number = (F.col("id") % 50).cast("double")
    large.range(100).select(
        month(), (F.col("id") % 10).alias("StationId"), F.timestamp_add("MINUTE", F.col("id") * 10, tg.ntz("2024-01-01 00:00:00")).alias("TimeStamp"),
        *[number.alias(c) for c in ("wtc_kWG1TotE_accum", "wtc_kWG1TotE_endvalue", "EffectiveAlarmTime")],
    ).write.parquet(path)
    assert exchanges(E.impute_energy(large.read.parquet(path))) == ["period, StationId"]


def signals(spark, station="long"):
    """Signal tables of two months, with cells that are missing, come twice or have no station, and what joins them."""
    key = [month(), F.when(F.col("id") % 50 != 7, F.col("id") % 5).cast(station).alias("StationId"), F.timestamp_add("MINUTE", F.col("id").cast("int") % 40 * 10, tg.ntz("2024-01-01 00:00:00")).alias("TimeStamp")]
    later = F.when(F.col("period") == "x", "2024-02").otherwise("2024-01")

    def table(first, *columns):
        rows = spark.range(first, 150).select(*key, *[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(columns)])
        return rows.unionByName(rows.limit(3)).withColumn("period", later)

    frames = {
        "cnt": table(20, E.ACCUM, E.COUNTER), "grd": table(0, "wtc_ActPower_min"), "tur": table(5, "wtc_AcWindSp_mean", "wtc_ActualWindDirection_mean"),
        "din": table(9, "wtc_PowerRed_timeon"), "flg": table(0, "wtc_ScInOper_timeon"), "met": spark.createDataFrame([], "period string, TimeStamp timestamp_ntz, met double"),
    }
    stopped = table(60, "EffectiveAlarmTime", "Period 0(s)", "Period 1(s)").withColumnRenamed("StationId", "StationNr")
    bounds = spark.createDataFrame([("2024-01",)], "period string").select("period", tg.ntz("2024-01-01 00:00:00").alias("period_start"), tg.ntz("2024-01-01 06:30:00").alias("period_end"))
    return frames, stopped, table(90, "Duration 2006(s)"), T.station_blocks(spark.range(6).withColumnRenamed("id", "StationId")), bounds


def test_cells_are_joined_and_filled_where_their_signals_come_to(large):
    """Each signal moves once, to its station's month; the wide rows, and the masts' values, do not move."""
    df = monthly.joined_cells(*signals(large), timedelta(minutes=10))
    shown = plan(df)
    # The grid and seven tables; what is left are the list of stations and the parts of the tables themselves.
    assert shown.count("Exchange shufflepartitionidpassthrough") == 8
    assert exchanges(df) == [] and "SortMergeJoin" in shown and "met" not in df.columns
    first = shown.index("SortMergeJoin")
    assert "Exchange" not in shown[:first]


@pytest.mark.parametrize("station", ["long", "int"])
def test_cells_joined_in_place_are_those_of_plain_joins(spark, station):
    frames, stopped, limited, stations, bounds = signals(spark, station)
    step = timedelta(minutes=10)
    got = monthly.joined_cells(frames, stopped, limited, stations, bounds, step)
    wide = G.join_signals(G.make_grid(stations, bounds, step), [stopped.withColumnRenamed("StationNr", "StationId"), limited, *[frames[k] for k in ("cnt", "grd", "tur", "din", "flg")]])
    names = ("EffectiveAlarmTime", "Period 0(s)", "Period 1(s)", "Duration 2006(s)")
    plain = E.impute_energy(wide.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in names}))
    assert sorted(got.columns) == sorted(plain.columns) and got.count() > 6 * 40
    # Of cells that come twice the gap windows may take either first: compared without what they fill.
    kept = [f"`{c}`" for c in plain.columns if c not in (E.ACCUM, "Energy_Source")]
    assert sorted(map(str, got.select(*kept).collect())) == sorted(map(str, plain.select(*kept).collect()))


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_cut_points_leave_no_shuffle_files(spark, tmp_path):
    """The shuffles of a frame that is stored are of no use afterwards; a long plan must not pile them up."""
    before = shuffle_files(spark)
    kept = settle(spark.range(5000).repartition(4, "id"))
    writers.write_results(spark.range(5000).select(month(), "id").repartition(4, "id"), str(tmp_path / "res"))
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and kept.count() == 5000
    assert spark.conf.get(writers.CLEANUP, None) in (None, "false")


def test_scan_never_shuffles_by_month_alone(large):
    met = large.range(1000).select(
        month(), (F.col("id") % 3).alias("StationId"),
        F.timestamp_add("MINUTE", F.col("id") * 10, tg.ntz("2024-01-01 00:00:00")).alias("TimeStamp"),
        F.rand(1).alias("met_WindSpeedRot_mean"),
    )
    ranges = large.createDataFrame([("2024-01",)], "period string").select(
        "period", tg.ntz("2024-01-01 00:00:00").alias("range_start"), tg.ntz("2024-01-08 00:00:00").alias("range_end")
    )
    # Rows meet the range of their month by broadcast; grouping is by station or by stamp.
    assert exchanges(Q.stuck_issues(Q.in_range(met, ranges))) == ["period, StationId"]
    assert all(e.startswith("period, StationId") for e in exchanges(Q.station_completeness(met, ranges)))


def test_bitmaps_of_stations_are_made_behind_the_shuffle(large):
    """A task with a few rows of many stations hands on those rows, not a bitmap of kilobytes for each station."""
    met = large.range(1000).select(month(), (F.col("id") % 300).alias("StationId"), F.timestamp_add("MINUTE", F.col("id") * 10, tg.ntz("2024-01-01 00:00:00")).alias("TimeStamp"))
    ranges = large.createDataFrame([("2024-01",)], "period string").select("period", tg.ntz("2024-01-01 00:00:00").alias("range_start"), tg.ntz("2024-01-08 00:00:00").alias("range_end"))
    by = ("StationId",)
    for df in (Q.station_completeness(met, ranges), Q.completeness(met, ranges, by=by), Q.missing_timestamps(met, ranges, by=by)):
        assert exchanges(df) == ["period, StationId"]
        assert "bitmap" not in plan(df).split("Exchange hashpartitioning(period, StationId", 1)[1]


def test_the_log_is_not_shuffled_by_batch(large):
    """A log of few batches would come to as many tasks; only the sizes of the batches are grouped by batch."""
    changes = {f.name: F.lit(None).cast(f.dataType) for f in J.CHANGE}
    log = large.range(20).select(*[c.alias(n) for n, c in (changes | {"id": F.col("id") % 3, "pos": F.col("id"), "removed": F.lit(False), "batch": (F.col("id") % 2).cast("string")}).items()])
    listed = large.range(5).select(F.col("id").alias("pos"), *[changes[c].alias(c) if c != "id" else F.col("id") for c in ("id", "alarm_code", "station_nr", "time_on", "time_off", "notes", "last_updated")])
    df = J.fold(listed, log)
    below = [e for e in exchanges(df) if e.startswith("batch")]
    # The sizes are made anew in every branch that reads the changes; none of these exchanges moves the log itself.
    assert "SortMergeJoin [batch]" not in plan(df) and below
    assert all("HashAggregate(keys=[batch], functions=[partial_" in part.split("\n")[1] for part in plan(df).split("Exchange hashpartitioning(batch")[1:])


def test_facts_are_read_and_shuffled_once(large):
    facts = large.range(5000).select(
        month(), (F.col("id") % 7).alias("StationNr"), F.timestamp_add("MINUTE", F.col("id"), tg.ntz("2024-01-01 00:00:00")).alias("made")
    )
    df = first_at_or_after(log(large), F.col("TimeOn"), facts, "made", ["period", "StationNr"], "found")
    assert plan(df).count("Range (0, 5000") == 1
    # The asks; the facts into arrays; the arrays under the window; the arrays to the asks.
    assert sorted(exchanges(df)) == ["period, StationNr", *["period, StationNr, _block"] * 3]
    assert all("_block" in by for _, by in windows(df))


def test_settled_frames_are_read_by_column(spark):
    rows = spark.range(5).selectExpr("id", "id * 1.5D AS `Period 0(s)`", "CAST(NULL AS STRING) AS text")
    kept = settle(rows)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect())) and kept.dtypes == rows.dtypes
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
