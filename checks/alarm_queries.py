"""Queries over the alarm operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query, view
from gustledger.functions import timegrid as tg
from gustledger.operators import adjustments as J
from gustledger.operators import alarms as A
from gustledger.operators import energy as E
from gustledger.operators import grid as G
from gustledger.plans.monthly import alarm_segments
from gustledger.plans.settle import settle
from gustledger.sources import extracts

STEP = tg.TEN_MINUTES
ALARM_OUT = '"ID", "StationNr", "TimeOn", "TimeOff", "Alarmcode"'
ALARM_COLS = ["ID", "StationNr", "TimeOn", "TimeOff", "Alarmcode"]


def complete(spark, d):
    """All alarms, the open ones closed where the month's data ends."""
    al = V.v_alarm(spark, d).join(bounds(spark, d).select("period", "period_end"), "period")
    return al.withColumn("TimeOff", F.coalesce("TimeOff", F.greatest("TimeOn", "period_end"))).drop("period_end")


def bounds(spark, d):
    return G.period_end(V.v_cell(spark, d))


view(
    "v_bounds",
    """SELECT period, make_timestamp(1704067200000000) AS period_start, max("TimeStamp") AS period_end,
  make_timestamp(1704067200000000 - 600000000) AS buffer FROM v_cell GROUP BY period""",
    "v_cell",
)
CLOSED = 'coalesce("TimeOff", greatest("TimeOn", b.period_end))'
view("v_typed", 'SELECT a.*, c."Error Type", c."UK Text" FROM v_alarm a JOIN v_code c USING ("Alarmcode") WHERE c."Error Type" IN (0, 1)', "v_alarm", "v_code")
view("v_stop", 'SELECT "Alarmcode" FROM v_code WHERE "Error Type" IN (0, 1)', "v_code")


# --------------------------------------------------------------- code joins

@query("alarm_dim_inner", f'SELECT {ALARM_OUT}, "Error Type", "UK Text" FROM v_typed', ["v_typed"])
def alarm_dim_inner(spark, d):
    return A.with_alarm_type(V.v_alarm(spark, d), V.v_code(spark)).select(*ALARM_COLS, "Error Type", "UK Text")


@query(
    "alarm_dim_left",
    f'SELECT {ALARM_OUT}, "Error Type", "UK Text" FROM v_alarm LEFT JOIN v_code USING ("Alarmcode")',
    ["v_alarm", "v_code"],
)
def alarm_dim_left(spark, d):
    return A.with_alarm_text(V.v_alarm(spark, d), V.v_code(spark)).select(*ALARM_COLS, "Error Type", "UK Text")


@query(
    "stopping_code_semi",
    f'SELECT {ALARM_OUT} FROM v_alarm WHERE "Alarmcode" IN (SELECT "Alarmcode" FROM v_stop)',
    ["v_alarm", "v_stop"],
)
def stopping_code_semi(spark, d):
    return A.stopping_alarms(V.v_alarm(spark, d), V.v_code(spark)).select(*ALARM_COLS)


# ------------------------------------------------------------------ listing

_VIEW = """SELECT "ID" AS id, "StationNr" AS station_nr, "Alarmcode" AS alarm_code,
  strftime("TimeOn", '%Y-%m-%dT%H:%M:%S') AS time_on, strftime("TimeOff", '%Y-%m-%dT%H:%M:%S') AS time_off,
  coalesce("Parameter", '') AS parameter, coalesce(CAST("Error Type" AS VARCHAR), 'Unknown') AS error_type,
  coalesce("UK Text", '') AS description FROM v_alarm LEFT JOIN v_code USING ("Alarmcode")"""


@query("source_alarm_view", _VIEW, ["v_alarm", "v_code"])
def source_alarm_view(spark, d):
    return A.source_alarms(V.v_alarm(spark, d), V.v_code(spark))


@query(
    "source_alarm_filter",
    f"""SELECT * FROM ({_VIEW}) WHERE error_type NOT IN ('0', '1')
  UNION ALL SELECT * FROM ({_VIEW}) WHERE error_type IN ('0', '1') AND alarm_code = 3203
  UNION ALL SELECT * FROM ({_VIEW}) WHERE station_nr = 7""",
    ["v_alarm", "v_code"],
)
def source_alarm_filter(spark, d):
    al, codes = V.v_alarm(spark, d), V.v_code(spark)
    return (
        A.source_alarms(al, codes, kind="non_stopping")
        .unionByName(A.source_alarms(al, codes, code=3203, kind="stopping"))
        .unionByName(A.source_alarms(al, codes, station=7))
    )


@query("source_alarm_order", f"{_VIEW} ORDER BY time_on DESC, id DESC", ["v_alarm", "v_code"])
def source_alarm_order(spark, d):
    return A.newest_first(A.source_alarms(V.v_alarm(spark, d), V.v_code(spark)))


@query(
    "alarm_order",
    f'SELECT {ALARM_OUT} FROM v_alarm ORDER BY "StationNr", "TimeOn", "ID"',
    ["v_alarm"],
)
def alarm_order(spark, d):
    return V.v_alarm(spark, d).select(*ALARM_COLS).orderBy("StationNr", "TimeOn", "ID")


# ----------------------------------------------------------------- clamping

view("v_prod", 'SELECT period, "StationId", "TimeStamp" FROM v_cnt WHERE "wtc_kWG1Tot_accum" BETWEEN -500 AND 500 AND "wtc_kWG1TotE_accum" BETWEEN 0 AND 500 AND "wtc_kWG1TotE_accum" > 0', "v_cnt")
view(
    "v_ended",
    """SELECT a.period, a."ID", a."StationNr", a."TimeOn",
  CASE WHEN a."TimeOff" IS NULL AND a."Alarmcode" IN (SELECT "Alarmcode" FROM v_stop) THEN f.produced ELSE a."TimeOff" END AS "TimeOff",
  a."Alarmcode", a."Parameter"
  FROM v_alarm a LEFT JOIN (
    SELECT o."ID", min(p."TimeStamp") AS produced FROM v_alarm o JOIN v_prod p
      ON p."StationId" = o."StationNr" AND p."TimeStamp" - INTERVAL 10 MINUTE >= o."TimeOn"
    WHERE o."TimeOff" IS NULL GROUP BY 1) f USING ("ID")""",
    "v_alarm", "v_stop", "v_prod",
)


def production(spark, d):
    return E.producing(E.sanity_filter(V.v_signal(spark, d, "cnt"), "cnt"), None)


@query("first_production_after", f"SELECT {ALARM_OUT} FROM v_ended", ["v_ended"])
def first_production_after(spark, d):
    flagged = A.flag_stopping(V.v_alarm(spark, d), V.v_code(spark))
    return A.impute_end_from_production(flagged, production(spark, d)).select(*ALARM_COLS)


_CLOSED = """FROM v_alarm a JOIN v_ended e USING ("ID") WHERE a."TimeOff" IS NULL AND a."Alarmcode" IN (SELECT "Alarmcode" FROM v_stop)"""


@query(
    "imputed_adjustments",
    f"""SELECT "ID" AS id, a."Alarmcode" AS alarm_code, a."StationNr" AS station_nr, strftime(e."TimeOff", '%Y-%m-%d %H:%M:%S') AS time_off,
  'Auto-imputed from production data' AS notes, "ID" % 2 = 0 AS stale {_CLOSED} AND e."TimeOff" IS NOT NULL""",
    ["v_alarm", "v_ended", "v_stop"],
)
def imputed_adjustments(spark, d):
    """Ends found by production enter the correction list; those of alarms that have got an end since are stale."""
    al = V.v_alarm(spark, d)
    requests = A.imputed_adjustments(A.flag_stopping(al, V.v_code(spark)), production(spark, d))
    none = requests.select("pos", "id", "alarm_code", "station_nr", "time_on", "time_off", "notes", F.lit(None).cast("string").alias("last_updated")).where(F.lit(False))
    listed = J.upsert_adjustments(none, requests, "2024-02-01T00:00:00")
    since = al.withColumn("TimeOff", F.when(F.col("ID") % 2 == 0, F.coalesce("TimeOff", "TimeOn")).otherwise(F.col("TimeOff")))
    stale = J.stale_adjustments(since, listed).withColumn("stale", F.lit(True))
    return listed.join(stale, "id", "left").select("id", "alarm_code", "station_nr", "time_off", "notes", F.coalesce("stale", F.lit(False)).alias("stale"))


@query(
    "left_open",
    f"""SELECT "ID", a."StationNr", a."TimeOn", a."Alarmcode" {_CLOSED} AND e."TimeOff" IS NULL""",
    ["v_alarm", "v_ended", "v_stop"],
)
def left_open(spark, d):
    out = A.left_open(A.flag_stopping(V.v_alarm(spark, d), V.v_code(spark)), production(spark, d))
    return out.select("ID", "StationNr", "TimeOn", "Alarmcode")


CLAMP = """SELECT period, "ID", "StationNr",
    CASE WHEN stopping AND "TimeOn" < buffer THEN buffer ELSE "TimeOn" END AS "TimeOn", "TimeOff", "Alarmcode", "Parameter",
    "TimeOn" AS raw_on
  FROM (SELECT period, "ID", "StationNr", "TimeOn", "Alarmcode", "Parameter", stopping, buffer, period_end,
    CASE WHEN filled > period_end THEN period_end ELSE filled END AS "TimeOff"
    FROM (SELECT e.*, b.buffer, b.period_end, e."Alarmcode" IN (SELECT "Alarmcode" FROM v_stop) AS stopping,
      CASE WHEN e."Alarmcode" IN (SELECT "Alarmcode" FROM v_stop) THEN coalesce(e."TimeOff", b.period_end) ELSE e."TimeOff" END AS filled
      FROM {source} e JOIN v_bounds b USING (period)) x) y
  WHERE NOT (stopping AND "TimeOn" < buffer AND "TimeOff" < buffer)
    AND "TimeOn" <= period_end AND (stopping OR "TimeOn" >= buffer)"""
view("v_clamped", CLAMP.format(source="v_ended"), "v_ended", "v_bounds", "v_stop")

# For the clamping rules themselves: a month that starts a day into the data.
view(
    "v_late",
    """SELECT period, make_timestamp(1704067200000000 + 86400000000) AS period_start, make_timestamp(1704067200000000 + 259200000000) AS period_end,
  make_timestamp(1704067200000000 + 85800000000) AS buffer FROM v_cell GROUP BY period""",
    "v_cell",
)
view("v_clamped_late", CLAMP.format(source="v_alarm").replace("v_bounds", "v_late"), "v_alarm", "v_late", "v_stop")


def late_bounds(spark, d):
    return V.v_cell(spark, d).select("period").distinct().select(
        "period", tg.ntz("2024-01-02 00:00:00").alias("period_start"), tg.ntz("2024-01-04 00:00:00").alias("period_end")
    )


@query("clamp_alarms", f"SELECT {ALARM_OUT} FROM v_clamped_late", ["v_clamped_late"])
def clamp_alarms(spark, d):
    flagged = A.flag_stopping(V.v_alarm(spark, d), V.v_code(spark))
    return A.clamp_alarms(flagged, late_bounds(spark, d)).select(*ALARM_COLS)


@query(
    "warning_date",
    """SELECT e.period, min(e."TimeOn") AS warning_date FROM v_alarm e JOIN v_late b USING (period)
  WHERE e."TimeOn" <= b.period_end AND NOT (e."Alarmcode" IN (SELECT "Alarmcode" FROM v_stop)
    AND e."TimeOn" < b.buffer AND coalesce(e."TimeOff", b.period_end) < b.buffer) GROUP BY 1""",
    ["v_alarm", "v_late", "v_stop"],
)
def warning_date(spark, d):
    flagged = A.flag_stopping(V.v_alarm(spark, d), V.v_code(spark))
    return A.earliest_start(flagged, late_bounds(spark, d))


ACTIVE = """SELECT a.period, a."ID", a."StationNr", a."TimeOn", coalesce(a."TimeOff", b.period_end) AS "TimeOff", a."Alarmcode"
  FROM {source} a JOIN {bounds} b USING (period) WHERE a."Alarmcode" = 2006 AND (
    (b.buffer < a."TimeOn" AND a."TimeOn" < b.period_end) OR (b.buffer < a."TimeOff" AND a."TimeOff" < b.period_end)
    OR (a."TimeOn" < b.buffer AND b.period_end < a."TimeOff"))"""
view("v_active", ACTIVE.format(source="v_clamped", bounds="v_bounds"), "v_clamped", "v_bounds")


@query("active_2006", f"SELECT {ALARM_OUT} FROM ({ACTIVE.format(source='v_alarm', bounds='v_late')})", ["v_alarm", "v_late"])
def active_2006(spark, d):
    return A.active_alarms(V.v_alarm(spark, d), late_bounds(spark, d)).select(*ALARM_COLS)


# ------------------------------------------------------------------ cascade

CASCADE = """SELECT *, abs(epoch_us("TimeOff") - epoch_us("NewTimeOn")) / 1e6 AS seconds FROM (
  SELECT *, CASE WHEN "TimeOff" <= reach THEN "TimeOff" WHEN "TimeOn" >= reach THEN "TimeOn" WHEN "TimeOff" > reach THEN reach END AS "NewTimeOn"
  FROM (SELECT *, coalesce(max("TimeOff") OVER (PARTITION BY period, "StationNr" ORDER BY "TimeOn", "ID"
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "TimeOn") AS reach FROM {source}) x) y"""
CASCADE_OUT = (
    'SELECT "ID", "StationNr", "TimeOn", "TimeOff", "NewTimeOn", seconds AS "EffectiveAlarmTime", '
    'CASE WHEN "Error Type" = 0 THEN seconds END AS "Period 0(s)", CASE WHEN "Error Type" = 1 THEN seconds END AS "Period 1(s)" FROM '
)
CASCADE_COLS = ["ID", "StationNr", "TimeOn", "TimeOff", "NewTimeOn", "EffectiveAlarmTime", "Period 0(s)", "Period 1(s)"]
view("v_complete", f'SELECT t.* REPLACE ({CLOSED} AS "TimeOff"), "TimeOn" AS raw_on FROM v_typed t JOIN v_bounds b USING (period)', "v_typed", "v_bounds")
view("v_cascade", CASCADE.format(source="v_complete"), "v_complete")


def typed(spark, d):
    al = complete(spark, d).withColumn("OldTimeOn", F.col("TimeOn")).withColumn("OldTimeOff", F.col("TimeOff"))
    return A.with_alarm_type(al, V.v_code(spark))


@query("cascade", CASCADE_OUT + "v_cascade", ["v_cascade"])
def cascade(spark, d):
    return A.cascade(typed(spark, d)).select(*CASCADE_COLS)


@query(
    "cascade_prev_end",
    """SELECT "ID", "StationNr", "TimeOn", "TimeOff", coalesce(max("TimeOff") OVER (PARTITION BY "StationNr" ORDER BY "TimeOn", "ID"
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "TimeOn") AS "TimeOffMax" FROM v_alarm""",
    ["v_alarm"],
)
def cascade_prev_end(spark, d):
    return A.previous_reach(V.v_alarm(spark, d)).select("ID", "StationNr", "TimeOn", "TimeOff", "TimeOffMax")


@query("abs_duration", 'SELECT "ID", seconds AS "EffectiveAlarmTime" FROM v_cascade', ["v_cascade"])
def abs_duration(spark, d):
    return A.cascade(typed(spark, d)).select("ID", "EffectiveAlarmTime")


@query(
    "zero_duration_filter",
    'SELECT "ID", "Alarmcode", seconds AS "EffectiveAlarmTime" FROM v_cascade WHERE NOT (seconds <= 0 AND "Alarmcode" <> 1005)',
    ["v_cascade"],
)
def zero_duration_filter(spark, d):
    return A.drop_zero_alarms(A.cascade(typed(spark, d))).select("ID", "Alarmcode", "EffectiveAlarmTime")


# Subtraction, one alarm at a time: cut points inside an alarm, then the pieces nobody covers.
SUBTRACT = """SELECT period, "ID", "StationNr", piece_on AS "TimeOn", piece_off AS "TimeOff", "Alarmcode", "Error Type", "UK Text"
FROM (
  SELECT a.*, CASE WHEN b.b_on IS NULL THEN a.a_on ELSE greatest(a.a_on, coalesce(max(b.b_off) OVER w, a.a_on)) END AS piece_on,
    CASE WHEN b.b_on IS NULL THEN a.a_off ELSE least(b.b_on, a.a_off) END AS piece_off
  FROM (SELECT *, "NewTimeOn" AS a_on, "TimeOff" AS a_off FROM {source} WHERE "Alarmcode" <> 1005 AND seconds > 0) a
  LEFT JOIN (SELECT period AS bp, "StationNr" AS bs, raw_on AS b_on, "TimeOff" AS b_off FROM {source} WHERE "Alarmcode" = 1005) b
    ON b.bp = a.period AND b.bs = a."StationNr" AND b.b_on < a.a_off AND b.b_off > a.a_on
  WINDOW w AS (PARTITION BY a.period, a."ID" ORDER BY b.b_on, b.b_off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL
  SELECT a.*, t.last_off AS piece_on, a.a_off AS piece_off
  FROM (SELECT *, "NewTimeOn" AS a_on, "TimeOff" AS a_off FROM {source} WHERE "Alarmcode" <> 1005 AND seconds > 0) a
  JOIN (SELECT a2.period AS tp, a2."ID" AS tid, max(b2."TimeOff") AS last_off FROM {source} a2 JOIN {source} b2
      ON b2."Alarmcode" = 1005 AND a2."Alarmcode" <> 1005 AND b2.period = a2.period AND b2."StationNr" = a2."StationNr"
      AND b2.raw_on < a2."TimeOff" AND b2."TimeOff" > a2."NewTimeOn" GROUP BY 1, 2) t
    ON t.tp = a.period AND t.tid = a."ID"
) z WHERE piece_on < piece_off
UNION ALL
SELECT period, "ID", "StationNr", raw_on, "TimeOff", "Alarmcode", "Error Type", "UK Text" FROM {source} WHERE "Alarmcode" = 1005"""
view("v_pieces", SUBTRACT.format(source="v_cascade"), "v_cascade")


@query("overlap_subtract", 'SELECT "ID", "StationNr", "TimeOn", "TimeOff", "Alarmcode" FROM v_pieces', ["v_pieces"])
def overlap_subtract(spark, d):
    return A.subtract_alarms(settle(A.cascade(typed(spark, d)))).select(*ALARM_COLS)


view("v_segments", CASCADE.format(source="v_pieces"), "v_pieces")


@query("union_segments", CASCADE_OUT + "v_segments", ["v_segments"])
def union_segments(spark, d):
    al = complete(spark, d).withColumn("OldTimeOn", F.col("TimeOn")).withColumn("OldTimeOff", F.col("TimeOff"))
    return alarm_segments(al, V.v_code(spark)).select(*CASCADE_COLS)


# ---------------------------------------------------------------- intervals

INTERVALS = """SELECT *, (least(epoch_us("TimeStamp"), epoch_us("TimeOff")) - greatest(epoch_us("TimeStamp") - 600000000, epoch_us("NewTimeOn"))) / 1e6 AS part
  FROM (SELECT *, make_timestamp(unnest(generate_series(((epoch_us("NewTimeOn") + 599999999) // 600000000) * 600000000,
    ((epoch_us("TimeOff") + 599999999) // 600000000) * 600000000, 600000000))) AS "TimeStamp" FROM {source}) x"""
view("v_intervals", INTERVALS.format(source="v_cascade").replace("FROM v_cascade", "FROM v_cascade WHERE seconds <> 0"), "v_cascade")


def intervals(spark, d):
    return A.to_intervals(A.cascade(typed(spark, d)).where(F.col("EffectiveAlarmTime") != 0))


@query(
    "convert_to_10min",
    """SELECT "ID", "StationNr", "TimeStamp", part AS "EffectiveAlarmTime",
  CASE WHEN "Error Type" = 0 THEN part ELSE 0.0 END::DOUBLE AS "Period 0(s)", CASE WHEN "Error Type" = 1 THEN part ELSE 0.0 END::DOUBLE AS "Period 1(s)" FROM v_intervals""",
    ["v_intervals"],
)
def convert_to_10min(spark, d):
    return intervals(spark, d).select("ID", "StationNr", "TimeStamp", "EffectiveAlarmTime", "Period 0(s)", "Period 1(s)")


@query("overlap_seconds", 'SELECT "ID", "TimeStamp", part AS seconds FROM v_intervals', ["v_intervals"])
def overlap_seconds(spark, d):
    return intervals(spark, d).select(
        "ID", "TimeStamp", tg.overlap_seconds(F.col("TimeStamp"), F.col("NewTimeOn"), F.col("TimeOff"), STEP).alias("seconds")
    )


BY_INTERVAL = """SELECT period, "StationNr", "TimeStamp", sum(part) AS "EffectiveAlarmTime",
  sum(CASE WHEN "Error Type" = 0 THEN part ELSE 0.0 END::DOUBLE) AS "Period 0(s)", sum(CASE WHEN "Error Type" = 1 THEN part ELSE 0.0 END::DOUBLE) AS "Period 1(s)",
  string_agg("UK Text", '|' ORDER BY "TimeOn", "ID") AS "UK Text" FROM {source} GROUP BY 1, 2, 3"""


@query("alarm_by_interval", BY_INTERVAL.format(source="v_intervals"), ["v_intervals"])
def alarm_by_interval(spark, d):
    return A.stopped_by_interval(A.cascade(typed(spark, d)).where(F.col("EffectiveAlarmTime") != 0))


@query("text_join", f'SELECT "StationNr", "TimeStamp", "UK Text" FROM ({BY_INTERVAL.format(source="v_intervals")})', ["v_intervals"])
def text_join(spark, d):
    return A.alarm_by_interval(intervals(spark, d)).select("StationNr", "TimeStamp", "UK Text")


view("v_limit_intervals", INTERVALS.format(source='(SELECT *, "TimeOn" AS "NewTimeOn" FROM v_active)'), "v_active")
view("v_limited", 'SELECT period, "StationNr" AS "StationId", "TimeStamp", sum(part) AS "Duration 2006(s)" FROM v_limit_intervals GROUP BY 1, 2, 3', "v_limit_intervals")


def limit_intervals(spark, d):
    flagged = A.flag_stopping(V.v_alarm(spark, d), V.v_code(spark))
    clamped = A.clamp_alarms(A.impute_end_from_production(flagged, production(spark, d)), bounds(spark, d))
    return A.to_intervals(A.active_alarms(clamped, bounds(spark, d)), split_types=False)


@query("duration_2006", "SELECT * FROM v_limited", ["v_limited"])
def duration_2006(spark, d):
    return A.warning_duration(limit_intervals(spark, d))


@query(
    "duration_2006_by_stamp",
    """SELECT period, "TimeStamp", arg_min("StationNr", ("TimeOn", "StationNr", "ID")) AS "StationId", sum(part) AS "Duration 2006(s)"
  FROM v_limit_intervals GROUP BY 1, 2""",
    ["v_limit_intervals"],
)
def duration_2006_by_stamp(spark, d):
    return A.warning_duration(limit_intervals(spark, d), per_station=False)


# --------------------------------------------------------------- time helpers

@query(
    "ceil_freq",
    """SELECT event_id, make_timestamp(((epoch_us(ts) + 599999999) // 600000000) * 600000000) AS stamp FROM events""",
)
def ceil_freq(spark, d):
    ev = V.table(spark, d, "events")
    return ev.select("event_id", tg.ceil_to(F.col("ts"), STEP).alias("stamp"))


@query(
    "interval_series",
    f"""SELECT "ID", unnest(generate_series("TimeOn", {CLOSED}, INTERVAL 10 MINUTE)) AS stamp FROM v_alarm JOIN v_bounds b USING (period)""",
    ["v_alarm", "v_bounds"],
)
def interval_series(spark, d):
    return complete(spark, d).select("ID", F.explode(tg.stamps(F.col("TimeOn"), F.col("TimeOff"), STEP)).alias("stamp"))


@query(
    "iso_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS text FROM events""",
)
def iso_text(spark, d):
    return V.table(spark, d, "events").select("event_id", tg.iso(F.col("ts")).alias("text"))


@query(
    "alarm_extract",
    f"""SELECT {ALARM_OUT}, "Parameter" FROM v_alarm WHERE "Alarmcode" <> 7001 AND (
    "TimeOff" BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-03' OR "TimeOn" BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-03'
    OR ("TimeOn" <= TIMESTAMP '2024-01-02' AND "TimeOff" >= TIMESTAMP '2024-01-03')
    OR ("TimeOff" IS NULL AND "Alarmcode" IN (SELECT "Alarmcode" FROM v_stop)))""",
    ["v_alarm", "v_stop"],
)
def alarm_extract(spark, d):
    stops = V.v_code(spark).where(F.col("Error Type").isin(0, 1))
    return extracts.alarm_extract(
        V.v_alarm(spark, d), stops, "2024-01-02 00:00:00", "2024-01-03 00:00:00", excluded=7001
    )
