"""Queries over the whole computations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks import alarm_queries as AQ
from checks import energy_queries as EQ
from checks import views as V
from checks.adjustment_queries import v_adjust
from checks.folders import fresh_folder
from checks.registry import VIEWS, query, view
from checks.source_queries import order_state
from gustledger.plans import monthly
from gustledger.plans.export import export_rows, incremental_export, publish_export
from gustledger.plans.settle import settle
from gustledger.plans.weekly import process_week
from gustledger.sources import readers, state, writers
from gustledger.sources import schemas as S


def frames(spark, d):
    # All signals of the check come from one table of cells: made once, read per signal.
    cells = settle(V.v_sig(spark, d))
    out = {k: cells.select(*V.KEY, *V.values(k)) for k in ("cnt", "grd", "tur", "din", "flg")}
    out["sum"] = V.v_alarm(spark, d)
    out["met"] = readers.pivot_met(V.v_mast(spark, d))
    return out


def lookups(spark, d):
    return {
        "codes": V.v_code(spark), "curve": EQ.curve(spark, d), "distribution": readers.wind_distribution(V.v_distribution(spark, d)),
        "season": readers.season_factor(V.v_season(spark, d)), "stations": V.v_station(spark, d),
    }


def month(spark, d, settings=monthly.Settings()):
    return monthly.full_calculation(frames(spark, d), settings=settings, **lookups(spark, d))


# ------------------------------------------------- the month in DuckDB, step by step

view("f_typed", 'SELECT a.*, c."Error Type", c."UK Text" FROM v_clamped a JOIN v_code c USING ("Alarmcode") WHERE c."Error Type" IN (0, 1)', "v_clamped", "v_code")
view("f_cascade", AQ.CASCADE.format(source="f_typed"), "f_typed")
view("f_pieces", AQ.SUBTRACT.format(source="f_cascade"), "f_cascade")
view("f_segments", AQ.CASCADE.format(source="f_pieces"), "f_pieces")
view("f_intervals", AQ.INTERVALS.format(source="f_segments").replace("FROM f_segments", "FROM f_segments WHERE seconds <> 0"), "f_segments")
view("f_stopped", AQ.BY_INTERVAL.format(source="f_intervals"), "f_intervals")
_CELL = '(period, "StationId", "TimeStamp")'
view(
    "f_counted",
    f"""SELECT g.*, m.* EXCLUDE (period, "TimeStamp"), coalesce(s."EffectiveAlarmTime", 0.0) AS "EffectiveAlarmTime", coalesce(s."Period 0(s)", 0.0) AS "Period 0(s)",
  coalesce(s."Period 1(s)", 0.0) AS "Period 1(s)", s."UK Text", coalesce(l."Duration 2006(s)", 0.0) AS "Duration 2006(s)", c.* EXCLUDE {_CELL}
  FROM v_grid g LEFT JOIN v_met_pivot m USING (period, "TimeStamp")
  LEFT JOIN (SELECT *, "StationNr" AS "StationId" FROM f_stopped) s USING {_CELL} LEFT JOIN v_limited l USING {_CELL} LEFT JOIN v_cnt_ok c USING {_CELL}""",
    "v_grid", "v_met_pivot", "f_stopped", "v_limited", "v_cnt_ok",
)
view("f_gaps", EQ.GAPS.format(source="f_counted"), "f_counted")
view("f_imputed", EQ.IMPUTED.format(bounded=EQ.BOUNDED.format(gaps="SELECT * FROM f_gaps")), "f_gaps")
view(
    "f_wide",
    f"""SELECT i.* EXCLUDE (missing, seen, gap_rows, counter_before, counter_after, energy_after, is_free, rest, free_rows), r.* EXCLUDE {_CELL},
  t."wtc_AcWindSp_mean", t."wtc_ActualWindDirection_mean", n.* EXCLUDE {_CELL}, f.* EXCLUDE {_CELL}
  FROM f_imputed i LEFT JOIN v_grd_ok r USING {_CELL} LEFT JOIN v_tur_ok t USING {_CELL} LEFT JOIN v_din_ok n USING {_CELL} LEFT JOIN v_flg f USING {_CELL}""",
    "f_imputed", "v_grd_ok", "v_tur_ok", "v_din_ok", "v_flg",
)

# The remaining steps are those of the single operators, on the joined month.
_STEPS = {"v_wide": "f_wide", "v_use": "f_use", "v_potential": "f_potential", "v_by_wind": "f_by_wind", "v_epot": "f_epot",
          "v_lossy": "f_epot", "v_split": "f_split", "v_neighbours": "f_neighbours", "v_patterns": "f_patterns"}
for _old, _new in _STEPS.items():
    if _old not in ("v_wide", "v_lossy"):
        _sql, _needs = VIEWS[_old]
        view(_new, re.sub(r"\bv_\w+", lambda m: _STEPS.get(m.group(0), m.group(0)), _sql), *[_STEPS.get(n, n) for n in _needs])

NUMBERS = [
    "EffectiveAlarmTime", "Period 0(s)", "Period 1(s)", "Duration 2006(s)", *S.SIGNAL_COLUMNS["cnt"], *S.SIGNAL_COLUMNS["grd"],
    "wtc_AcWindSp_mean", "wtc_ActualWindDirection_mean", "wtc_PowerRed_timeon", "wtc_ScInOper_timeon",
    "met_WindSpeedRot_mean_38", "met_WinddirectionRot_mean_246", "Energy_To_Use", "Epot", "Correction Factor",
    "EL", "ELX", "ELNX", "EL_PowerRed", "EL_2006", "EL_wind", "EL_wind_start", "EL_alarm_start", "EL_Misassigned",
    "Duration lowind(s)", "Duration lowind_start(s)", "Duration alarm_start(s)", *EQ._NEAR,
]
TEXTS = ["UK Text", "Energy_Source", "Epot_Method"]


def even_round(column: str) -> str:
    return f'round_even("{column}" * 100, 0) / 100 AS "{column}"'


FULL_SQL = f"""SELECT period, "StationId", "TimeStamp", "Available Turbines", {", ".join(f'"{t}"' for t in TEXTS)},
  {", ".join(even_round(c) for c in NUMBERS)} FROM f_patterns"""


@query("full_calculation", FULL_SQL, ["f_patterns"])
def full_calculation(spark, d):
    return month(spark, d).select("period", "StationId", "TimeStamp", "Available Turbines", *TEXTS, *NUMBERS)


# ------------------------------------------------------------------- weekly

WEEK = ("2024-01-02 00:00:00", "2024-01-04 23:50:00")
_WEEK_ROWS = f"(SELECT * FROM ({FULL_SQL}) a WHERE \"TimeStamp\" BETWEEN TIMESTAMP '{WEEK[0]}' AND TIMESTAMP '{WEEK[1]}')"


@query(
    "weekly_top",
    f"""SELECT "StationId", format('{{:,.2f}}', lost) AS lost_mwh FROM (SELECT "StationId" + 1 AS "StationId",
  round(round(sum("ELNX") / 1e3, 2) + round(sum("ELX") / 1e3, 2), 2) AS lost FROM {_WEEK_ROWS} GROUP BY 1) x ORDER BY lost DESC, "StationId" LIMIT 15""",
    ["f_patterns"],
)
def weekly_top(spark, d):
    """Calculate, store, and report a week from the stored month."""
    none = v_adjust(spark, d).limit(0)
    done = process_week(spark, lambda _: frames(spark, d), lookups(spark, d), fresh_folder(spark), *WEEK, "2024-02-01T00:00:00", none, first_station=0)
    return done.top.select("StationId", F.format_number("lost_mwh", 2).alias("lost_mwh"))


# ------------------------------------------------------------------- export

_OVERLAID = """SELECT a."ID", a."StationNr", a."Alarmcode", coalesce(n.t_on, a."TimeOn") AS "TimeOn", coalesce(f.t_off, a."TimeOff") AS "TimeOff" FROM v_alarm a
  LEFT JOIN (SELECT "ID", arg_max(t_on, pos) AS t_on FROM v_judged WHERE NOT stale AND t_on IS NOT NULL GROUP BY 1) n USING ("ID")
  LEFT JOIN (SELECT "ID", arg_max(t_off, pos) AS t_off FROM v_judged WHERE NOT stale AND t_off IS NOT NULL GROUP BY 1) f USING ("ID")"""


@query(
    "export_alarms",
    f"""SELECT * FROM ({_OVERLAID}) s WHERE "Alarmcode" <> 7001 UNION ALL SELECT "ID", "StationNr", "Alarmcode", "TimeOn", "TimeOff" FROM v_alarm
  WHERE "Alarmcode" = 7001""",
    ["v_alarm", "v_judged"],
)
def export_alarms(spark, d):
    """Append mode: the source without one code is corrected, the stored copy keeps what the source lost."""
    columns = ["ID", "StationNr", "Alarmcode", "TimeOn", "TimeOff"]
    al = V.v_alarm(spark, d).select(columns)
    return export_rows("sum", al.where(F.col("Alarmcode") != 7001), al, v_adjust(spark, d), "append").select(columns)


# Orders as alarms: 1997 was edited since the last export, every eleventh row of the source is gone there,
# months from 2000 on are new, and the others are as they were.
@query(
    "export_incremental",
    """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderkey, o_custkey, o_orderpriority,
    year(o_orderdate) = 1997 AND o_orderkey % 11 = 0 AS lost, year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT' AS edited FROM orders),
  m AS (SELECT period FROM o GROUP BY 1 HAVING period >= '2000-01' OR bool_or(lost OR edited))
SELECT period, o_orderkey AS "ID", CAST(CASE WHEN edited AND NOT lost THEN o_custkey + 1 ELSE o_custkey END AS BIGINT) AS o_custkey, o_orderpriority,
  count(*) FILTER (WHERE NOT lost) OVER (PARTITION BY period) AS row_count
FROM o JOIN m USING (period)""",
)
def export_incremental(spark, d):
    columns = ["ID", "o_custkey", "o_orderpriority"]

    def orders(changed):
        return order_state(spark, d, changed).withColumnRenamed("o_orderkey", "ID")

    lost = (F.substring("period", 1, 4) == "1997") & (F.col("ID") % 11 == 0)
    stored = orders(False)
    log = state.state_checksum(stored, columns, ["period"]).withColumn("last_updated", F.lit("2024-01-01T00:00:00"))
    done = incremental_export("sum", orders(True).where(~lost), stored, log, columns, "2024-02-01T00:00:00")
    return done.rows.join(done.state.select("period", "row_count"), "period").select("period", "ID", "o_custkey", "o_orderpriority", "row_count")


# The same, on a stored table: the first run writes everything, the second the changed months only.
@query(
    "export_published",
    """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderkey, o_custkey, o_orderpriority,
    year(o_orderdate) = 1997 AND o_orderkey % 11 = 0 AS lost, year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT' AS edited FROM orders),
  m AS (SELECT period, period >= '2000-01' OR bool_or(lost OR edited) AS again FROM o GROUP BY 1)
SELECT period, o_orderkey AS "ID", CAST(CASE WHEN edited AND NOT lost THEN o_custkey + 1 ELSE o_custkey END AS BIGINT) AS o_custkey, o_orderpriority,
  CASE WHEN again THEN '2024-02-01' ELSE '2024-01-01' END AS last_updated
FROM o JOIN m USING (period)""",
)
def export_published(spark, d):
    columns = ["ID", "o_custkey", "o_orderpriority"]
    lost = (F.substring("period", 1, 4) == "1997") & (F.col("ID") % 11 == 0)
    first, second = (order_state(spark, d, changed).withColumnRenamed("o_orderkey", "ID") for changed in (False, True))
    path = fresh_folder(spark)
    publish_export(spark, "sum", first, path, columns, "2024-01-01")
    publish_export(spark, "sum", second.where(~lost), path, columns, "2024-02-01")
    states = state.latest_state(spark.read.parquet(f"{path}_state"), ["period"])
    return spark.read.parquet(path).join(states.select("period", "last_updated"), "period").select("period", *columns, "last_updated")
