"""Queries over the monthly and weekly indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.energy_queries import rounded
from checks.registry import query
from gustledger.functions.angles import circular_mean
from gustledger.functions.numbers import format_numbers
from gustledger.operators import kpi as K

MASTS = (38, 39, 246)
START, END = "1997-03-03 00:00:00", "1997-05-09 23:50:00"
DAYS = 68
WINDOW = f"\"TimeStamp\" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"

SUMS = ["EL", "ELX", "ELNX", "EL_2006", "EL_PowerRed", "EL_Misassigned", "EL_wind", "EL_wind_start", "EL_alarm_start", "wtc_kWG1TotE_accum"]
_E = '"wtc_kWG1TotE_accum"'
_OWN = '("ELX" - "EL_Misassigned")'
_MAKER = '("ELNX" + "EL_2006" + "EL_PowerRed" + "EL_Misassigned")'
GROUPED_SQL = f"""SELECT *, 100 * ({_E} + "ELX") / nullif({_E} + "ELX" + "ELNX" + "EL_2006" + "EL_PowerRed", 0) AS "MAA_brut",
  round(100 * ({_E} + {_OWN}) / nullif({_E} + {_OWN} + {_MAKER}, 0), 2) AS "MAA_brut_mis",
  100 * ({_E} + "ELX") / nullif({_E} + "EL" - ("EL_wind" + "EL_wind_start" + "EL_alarm_start"), 0) AS "MAA_indefni_adjusted"
  FROM (SELECT period, "StationId", {", ".join(f'round(coalesce(sum("{c}"), 0), 2) AS "{c}"' for c in SUMS)} FROM v_result GROUP BY 1, 2) g"""


def grouped(spark, d):
    return K.grouped_results(V.v_result(spark, d), SUMS)


@query(
    "grouped_results",
    f'SELECT * REPLACE (round("MAA_brut", 6) AS "MAA_brut", round("MAA_indefni_adjusted", 4) AS "MAA_indefni_adjusted") FROM ({GROUPED_SQL})',
    ["v_result"],
)
def grouped_results(spark, d):
    out = grouped(spark, d)
    return out.withColumn("MAA_brut", F.round("MAA_brut", 6)).withColumn("MAA_indefni_adjusted", F.round("MAA_indefni_adjusted", 4))


@query(
    "row_number_index",
    """SELECT row_number() OVER (PARTITION BY period ORDER BY "StationId") AS "row", period, "StationId" FROM (SELECT DISTINCT period, "StationId" FROM v_result) x""",
    ["v_result"],
)
def row_number_index(spark, d):
    return K.numbered(grouped(spark, d)).select(F.col("row").cast("long").alias("row"), "period", "StationId")


@query("date_window_filter", f'SELECT "StationId", "TimeStamp", "EL" FROM v_result WHERE {WINDOW}', ["v_result"])
def date_window_filter(spark, d):
    return K.between_times(V.v_result(spark, d), "TimeStamp", START, END).select("StationId", "TimeStamp", "EL")


def circular_sql(column: str) -> str:
    return (
        f'(degrees(atan2(coalesce(sum(sin(radians({column}))), 0), coalesce(sum(cos(radians({column}))), 0))) + 360) % 360'
    )


_WIND = '"met_WindSpeedRot_mean_{}"'
_DIR = '"met_WinddirectionRot_mean_{}"'


@query(
    "circular_mean",
    f'SELECT period, round({circular_sql(_DIR.format(38))}, 6) AS mean_direction FROM v_result GROUP BY 1',
    ["v_result"],
)
def circular(spark, d):
    mean = circular_mean(F.col("met_WinddirectionRot_mean_38"))
    return V.v_result(spark, d).groupBy("period").agg(F.round(mean, 6).alias("mean_direction"))


@query(
    "mean_wind",
    f"""SELECT round((a + b) / 2, 2) AS mean_wind FROM (SELECT avg({_WIND.format(38)}) AS a, avg({_WIND.format(39)}) AS b FROM v_result) x""",
    ["v_result"],
)
def mean_wind(spark, d):
    return K.mean_wind(V.v_result(spark, d), MASTS)


@query(
    "mean_direction",
    f"""SELECT round((degrees(atan2(sin(radians(a)) + sin(radians(b)), cos(radians(a)) + cos(radians(b)))) + 360) % 360, 6) AS mean_direction
  FROM (SELECT {circular_sql(_DIR.format(38))} AS a, {circular_sql(_DIR.format(39))} AS b FROM v_result) x""",
    ["v_result"],
)
def mean_direction(spark, d):
    return rounded(K.mean_direction(V.v_result(spark, d), MASTS))


KPI_SQL = f"""SELECT round(100 * {_MAKER} / ({_E} + {_OWN} + {_MAKER}), 2) AS maker_energy_pct, round({_MAKER} / 1e3, 2) AS maker_energy_mwh,
  round(100 * p1 / 3600 / 24 / 131 / {DAYS}, 2) AS maker_time_pct, round(p1 / 3600, 2) AS maker_time_hours,
  round(100 * {_OWN} / ({_E} + {_OWN} + {_MAKER}), 2) AS own_energy_pct, round({_OWN} / 1e3, 2) AS own_energy_mwh,
  round(100 * p0 / 3600 / 24 / 131 / {DAYS}, 2) AS own_time_pct, round(p0 / 3600, 2) AS own_time_hours,
  round((w1 + w2) / 2, 2) AS mean_wind, round((degrees(atan2(sin(radians(d1)) + sin(radians(d2)), cos(radians(d1)) + cos(radians(d2)))) + 360) % 360, 6) AS mean_direction
  FROM (SELECT {", ".join(f'sum("{c}") AS "{c}"' for c in SUMS)}, sum("Period 0(s)") AS p0, sum("Period 1(s)") AS p1, avg({_WIND.format(38)}) AS w1, avg({_WIND.format(39)}) AS w2,
    {circular_sql(_DIR.format(38))} AS d1, {circular_sql(_DIR.format(39))} AS d2 FROM v_result WHERE {WINDOW}) x"""


def week(spark, d):
    return K.weekly_kpi(V.v_result(spark, d), START, END, masts=MASTS)


@query("weekly_kpi", KPI_SQL, ["v_result"])
def weekly_kpi(spark, d):
    return week(spark, d).withColumn("mean_direction", F.round("mean_direction", 6))


@query("weekly_kpi_of_days", KPI_SQL, ["v_result"])
def weekly_kpi_of_days(spark, d):
    days = K.daily_partials(V.v_result(spark, d), MASTS)
    return K.weekly_kpi_of_days(days, START, END, masts=MASTS).withColumn("mean_direction", F.round("mean_direction", 6))


@query(
    "weekly_report",
    "SELECT " + ", ".join(f"format('{{:,.2f}}', {k}) AS \"{v}\"" for k, v in K.WEEKLY_NAMES.items()) + f" FROM ({KPI_SQL}) y",
    ["v_result"],
)
def weekly_report(spark, d):
    return K.weekly_report(week(spark, d))


@query(
    "format_report",
    """SELECT l_orderkey, l_linenumber, l_partkey, format('{:,.2f}', l_extendedprice) AS price FROM lineitem""",
)
def format_report(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"))
    return format_numbers(li, skip=("l_orderkey", "l_linenumber", "l_partkey"))


_TOP = """SELECT "StationId" - 0 + 1 AS "StationId", round(round(sum("ELNX") / 1e3, 2) + round(sum("ELX") / 1e3, 2), 2) AS lost_mwh
  FROM v_result {where} GROUP BY 1 ORDER BY lost_mwh DESC, "StationId" LIMIT 15"""


@query("top_loss", _TOP.format(where=f"WHERE {WINDOW}"), ["v_result"])
def top_loss(spark, d):
    return rounded(K.top_loss(V.v_result(spark, d), START, END, first_station=0), 2)


@query("top_loss_of_days", _TOP.format(where=f"WHERE {WINDOW}"), ["v_result"])
def top_loss_of_days(spark, d):
    return rounded(K.top_loss(K.daily_partials(V.v_result(spark, d), MASTS), START, END, first_station=0), 2)


@query("top_loss_whole_months", _TOP.format(where=""), ["v_result"])
def top_loss_whole_months(spark, d):
    return rounded(K.top_loss(V.v_result(spark, d), first_station=0), 2)
