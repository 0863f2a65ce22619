"""Wind-farm views over the driver's tables, in Spark and as DuckDB subqueries.

Alarms come from ``events`` (time squeezed sevenfold, so they fall on the signals),
signals from ``lineitem``: station = supplier, ten-minute stamp = ship day / 4, all
values from exact integer arithmetic on the rows of a cell.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import view
from gustledger.functions import timegrid as tg

START = datetime(2024, 1, 1)
START_US = 1704067200000000
STEP_US = 600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, tg.ntz("1970-01-01 00:00:00"))


def whole(column: str) -> Column:
    """A price or rate with two decimals as a whole number of hundredths."""
    return F.round(F.col(column) * 100).cast("long")


def div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


# ------------------------------------------------------------------- alarms

CODES = {"error": 1001, "view": 3203, "signup": 1005, "purchase": 2006, "click": 7001}


def v_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    on_us = F.lit(START_US) + div(tg.epoch_micros(F.col("ts")) - START_US, 7_000_000) * 1_000_000
    long_us = F.round(F.col("value") * 60).cast("long") * 1_000_000
    code = F.lit(None).cast("int")
    for kind, number in CODES.items():
        code = F.when(F.col("event_type") == kind, number).otherwise(code)
    return ev.select(
        F.lit("2024-01").alias("period"),
        F.col("event_id").alias("ID"),
        F.col("user_id").alias("StationNr"),
        at(on_us).alias("TimeOn"),
        F.when(F.col("event_id") % 50 != 0, at(on_us + long_us)).alias("TimeOff"),
        code.alias("Alarmcode"),
        F.col("props").alias("Parameter"),
    )


view(
    "v_alarm",
    f"""SELECT '2024-01' AS period, event_id AS "ID", user_id AS "StationNr", make_timestamp(on_us) AS "TimeOn",
  CASE WHEN event_id % 50 <> 0 THEN make_timestamp(on_us + CAST(round(value * 60) AS BIGINT) * 1000000) END AS "TimeOff",
  CASE event_type WHEN 'error' THEN 1001 WHEN 'view' THEN 3203 WHEN 'signup' THEN 1005 WHEN 'purchase' THEN 2006 WHEN 'click' THEN 7001 END AS "Alarmcode",
  props AS "Parameter"
  FROM (SELECT *, {START_US} + ((epoch_us(ts) - {START_US}) // 7000000) * 1000000 AS on_us FROM events) t""",
)


def v_code(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES (1001, 1, 'Pitch fault'), (3203, 0, 'Stop low wind'), (1005, 1, 'Maintenance'), "
        "(2006, CAST(NULL AS INT), 'Local power limit') AS t(Alarmcode, `Error Type`, `UK Text`)"
    )


view(
    "v_code",
    """SELECT * FROM (VALUES (1001, 1, 'Pitch fault'), (3203, 0, 'Stop low wind'), (1005, 1, 'Maintenance'),
  (2006, CAST(NULL AS INT), 'Local power limit')) AS t("Alarmcode", "Error Type", "UK Text")""",
)


# ------------------------------------------------------------------ signals


def v_cell(spark: SparkSession, sf_dir: str, run: int | None = None) -> DataFrame:
    """Exact integer facts of every (station, stamp) cell.

    With ``run`` the line items move to the stretch of so many stamps that holds them, and the cells
    are made there; ``_run`` is its number.
    """
    li = table(spark, sf_dir, "lineitem")
    idx = div(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")), 4).cast("long")
    rows = li.select(
        F.col("l_suppkey").alias("StationId"),
        idx.alias("idx"),
        "l_quantity",
        whole("l_extendedprice").alias("price"),
        whole("l_discount").alias("disc"),
        whole("l_tax").alias("tax"),
    )
    if run is not None:
        rows = rows.withColumn("_run", div(F.col("idx"), run)).repartition("StationId", "_run")
    return (
        rows.groupBy("StationId", "idx", *([] if run is None else ["_run"]))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").alias("qs"),
            F.min("l_quantity").alias("qmin"),
            F.max("l_quantity").alias("qmax"),
            F.sum("price").alias("ps"),
            F.sum("disc").alias("ds"),
            F.sum("tax").alias("ts"),
        )
        .withColumn("TimeStamp", at(F.lit(START_US) + F.col("idx") * STEP_US))
        .withColumn("period", F.lit("2024-01"))
    )


view(
    "v_cell",
    f"""SELECT "StationId", idx, n, qs, qmin, qmax, ps, ds, ts, make_timestamp({START_US} + idx * {STEP_US}) AS "TimeStamp", '2024-01' AS period
  FROM (SELECT l_suppkey AS "StationId", CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) // 4 AS BIGINT) AS idx,
    count(*) AS n, sum(l_quantity) AS qs, min(l_quantity) AS qmin, max(l_quantity) AS qmax,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS ps,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS ds,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS ts
    FROM lineitem GROUP BY 1, 2) t""",
)

KEY = ["period", "StationId", "TimeStamp"]

# Each signal value as one expression that both engines read alike.
SIGNAL_SQL: dict[str, dict[str, str]] = {
    "tur": {
        "wtc_AcWindSp_mean": "CASE WHEN ds % 11 <> 3 THEN qs / n / 2 END",
        "wtc_AcWindSp_stddev": "(qmax - qmin) / 4",
        "wtc_ActualWindDirection_mean": "(ps % 36500) / 100.0e0",
        "wtc_ActualWindDirection_stddev": "ts * 1.0e0",
    },
    "grd": {
        "wtc_ActPower_min": "qmin * 40 - 200",
        "wtc_ActPower_max": "CASE WHEN ps % 17 = 0 THEN 2700.0e0 ELSE qmax * 52 END",
        "wtc_ActPower_mean": "qs / n * 46 - 100",
    },
    "cnt": {
        "wtc_kWG1Tot_accum": "CASE WHEN ts % 5 <> 2 THEN (ps % 52000) / 100.0e0 - 5 END",
        "wtc_kWG1TotE_accum": "CASE WHEN ts % 5 <> 2 THEN (ps % 45000) / 100.0e0 END",
        "wtc_kWG1TotI_accum": "ts * 0.5e0",
        "wtc_kWG1Tot_endvalue": "cum / 100.0e0 - 5",
        "wtc_kWG1TotE_endvalue": "CASE WHEN ds % 23 <> 5 THEN cum / 100.0e0 END",
        "wtc_BoostKWh_endvalue": "ds * 1.0e0",
        "wtc_BostkWhS_endvalue": "ds * 2.0e0",
    },
    "din": {
        "wtc_PowerRed_timeon": "CASE WHEN ds % 13 = 5 THEN 700.0e0 WHEN ds % 3 = 0 THEN 0.0e0 WHEN ds % 3 = 2 THEN 300.0e0 END"
    },
    "flg": {"wtc_ScInOper_timeon": "CASE WHEN ds % 10 = 9 THEN 0.0e0 ELSE 600.0e0 END"},
}

_ALIVE = "ps % 13 <> 0"
_WIND = f"{_ALIVE} AND ds % 7 <> 6"
_LEVEL = "floor(qs / n / 10)"
SIGNAL_SQL["met"] = {
    "met_WindSpeedRot_mean": f"CASE WHEN {_WIND} THEN {_LEVEL} * 10.5e0 END",
    "met_WindSpeedRot_min": f"CASE WHEN {_WIND} THEN {_LEVEL} * 10.0e0 END",
    "met_WindSpeedRot_max": f"CASE WHEN {_WIND} THEN {_LEVEL} * 11.0e0 END",
    "met_WindSpeedRot_stddev": f"CASE WHEN {_WIND} THEN 0.5e0 END",
    "met_WinddirectionRot_mean": f"CASE WHEN {_ALIVE} AND ps % 11 <> 0 THEN (ps % 400) * 1.0e0 END",
    "met_WinddirectionRot_min": f"CASE WHEN {_ALIVE} AND ps % 11 <> 0 THEN (ps % 400) - 5.0e0 END",
    "met_WinddirectionRot_max": f"CASE WHEN {_ALIVE} AND ps % 11 <> 0 THEN (ps % 400) + 5.0e0 END",
    "met_WinddirectionRot_stddev": f"CASE WHEN {_ALIVE} THEN 1.0e0 END",
    "met_Pressure_mean": f"CASE WHEN {_ALIVE} THEN 780.0e0 + ds * 10 END",
    "met_Pressure_min": f"CASE WHEN {_ALIVE} THEN 779.0e0 + ds * 10 END",
    "met_Pressure_max": f"CASE WHEN {_ALIVE} THEN 781.0e0 + ds * 10 END",
    "met_Pressure_stddev": f"CASE WHEN {_ALIVE} THEN 0.25e0 END",
    "met_TemperatureTen_mean": f"CASE WHEN {_ALIVE} AND ts % 4 <> 3 THEN ts * 10.0e0 - 20 END",
    "met_TemperatureTen_min": f"CASE WHEN {_ALIVE} AND ts % 4 <> 3 THEN ts * 10.0e0 - 21 END",
    "met_TemperatureTen_max": f"CASE WHEN {_ALIVE} AND ts % 4 <> 3 THEN ts * 10.0e0 - 19 END",
    "met_TemperatureTen_stddev": f"CASE WHEN {_ALIVE} AND ts % 4 <> 3 THEN 0.1e0 END",
}

# Values a finished month would hold next to the signals, for the loss operators.
SIGNAL_SQL["state"] = {
    "Period 0(s)": "CASE WHEN ds % 4 = 1 THEN 200.0e0 ELSE 0.0e0 END",
    "Period 1(s)": "CASE WHEN ts % 4 = 1 THEN 400.0e0 ELSE 0.0e0 END",
    "EffectiveAlarmTime": "CASE WHEN ds % 4 = 1 THEN 200.0e0 ELSE 0.0e0 END + CASE WHEN ts % 4 = 1 THEN 400.0e0 ELSE 0.0e0 END",
    "Duration 2006(s)": "CASE WHEN ps % 7 = 0 THEN 300.0e0 ELSE 0.0e0 END",
    "UK Text": "CASE WHEN ds % 4 = 1 AND ts % 4 = 1 THEN 'Pitch fault|Stop low wind' WHEN ds % 4 = 1 THEN 'Stop low wind' WHEN ts % 4 = 1 THEN 'Pitch fault' END",
}

_CUM_OVER = 'PARTITION BY "StationId", idx {div} 200 ORDER BY idx ROWS UNBOUNDED PRECEDING'
view(
    "v_sig",
    "SELECT *, CAST(sum(ps % 45000) OVER (" + _CUM_OVER.format(div="//") + ") AS BIGINT) AS cum FROM v_cell",
    "v_cell",
)


def columns_sql(kind: str) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in SIGNAL_SQL[kind].items())


for _kind in SIGNAL_SQL:
    view(f"v_{_kind}", f'SELECT period, "StationId", "TimeStamp", {columns_sql(_kind)} FROM v_sig', "v_sig")

view(
    "v_wide",
    'SELECT period, "StationId", "TimeStamp", '
    + ", ".join(columns_sql(k) for k in ("state", "cnt", "grd", "tur", "din", "flg"))
    + " FROM v_sig",
    "v_sig",
)


def v_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the running energy counter, which starts again every 200 stamps.

    The line items move once, to the stretch their counter runs over; cells and counter are made there.
    """
    running = F.expr("sum(ps % 45000) OVER (PARTITION BY StationId, _run ORDER BY idx ROWS UNBOUNDED PRECEDING)")
    return v_cell(spark, sf_dir, 200).withColumn("cum", running).drop("_run")


def values(kind: str) -> list[Column]:
    return [F.expr(sql).cast("string" if name == "UK Text" else "double").alias(name) for name, sql in SIGNAL_SQL[kind].items()]


def v_signal(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    base = v_sig(spark, sf_dir) if kind == "cnt" else v_cell(spark, sf_dir)
    return base.select(*KEY, *values(kind))


def v_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("state", "cnt", "grd", "tur", "din", "flg")
    return v_sig(spark, sf_dir).select(*KEY, *[c for k in kinds for c in values(k)])


# Masts: one per return flag, rows of a stamp averaged over whole numbers.
MAST = {"A": 38, "N": 39, "R": 246}


def v_mast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mast rows, several per stamp: one per line number."""
    li = table(spark, sf_dir, "lineitem")
    mast = F.lit(None).cast("long")
    for flag, number in MAST.items():
        mast = F.when(F.col("l_returnflag") == flag, number).otherwise(mast)
    idx = div(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")), 4).cast("long")
    return li.select(
        F.lit("2024-01").alias("period"),
        mast.alias("StationId"),
        at(F.lit(START_US) + idx * STEP_US).alias("TimeStamp"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 2).alias("met_WindSpeedRot_mean"),
        (whole("l_extendedprice") % 360).cast("double").alias("met_WinddirectionRot_mean"),
    )


view(
    "v_mast",
    f"""SELECT '2024-01' AS period, CASE l_returnflag WHEN 'A' THEN 38 WHEN 'N' THEN 39 WHEN 'R' THEN 246 END AS "StationId",
  make_timestamp({START_US} + (date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) // 4) * {STEP_US}) AS "TimeStamp",
  CASE WHEN l_linenumber <> 3 THEN l_quantity / 2 END AS "met_WindSpeedRot_mean",
  CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 360 AS DOUBLE) AS "met_WinddirectionRot_mean" FROM lineitem""",
)

# ------------------------------------------------------- lookups from part etc.


def v_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_size") / 2.0).alias("Wind"), (F.col("p_size") * F.col("p_size")).alias("Power"))


view("v_curve", 'SELECT DISTINCT p_size / 2.0e0 AS "Wind", p_size * p_size AS "Power" FROM part')


def v_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_quantity").cast("int").alias("bin"))
        .agg((F.count(F.lit(1)) / 8.0).alias("value"))
    )


view("v_distribution", "SELECT CAST(l_quantity AS INT) AS bin, count(*) / 8.0e0 AS value FROM lineitem GROUP BY 1")


def v_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.month("o_orderdate").alias("month"))
        .agg((F.count(F.lit(1)) / 1024.0).alias("value"))
    )


view("v_season", "SELECT CAST(month(o_orderdate) AS INT) AS month, count(*) / 1024.0e0 AS value FROM orders GROUP BY 1")


def v_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("StationId"))


view("v_station", 'SELECT s_suppkey AS "StationId" FROM supplier')


# ---------------------------------------------------------- finished results

RESULT_SQL = {
    "EL": "(price % 40000) / 100.0e0",
    "ELX": "(price % 9000) / 100.0e0",
    "ELNX": "(price % 7000) / 100.0e0",
    "EL_2006": "(price % 300) / 100.0e0",
    "EL_PowerRed": "(price % 500) / 100.0e0",
    "EL_Misassigned": "(price % 1100) / 100.0e0",
    "EL_wind": "CASE WHEN tax = 3 THEN (price % 2500) / 100.0e0 END",
    "EL_wind_start": "CASE WHEN tax = 4 THEN (price % 2300) / 100.0e0 END",
    "EL_alarm_start": "CASE WHEN tax = 5 THEN (price % 2100) / 100.0e0 END",
    "wtc_kWG1TotE_accum": "CASE WHEN tax <> 7 THEN (price % 45000) / 100.0e0 END",
    "Period 0(s)": "(price % 600) * 1.0e0",
    "Period 1(s)": "(price % 500) * 1.0e0",
    "met_WindSpeedRot_mean_38": "CASE WHEN disc <> 2 THEN l_quantity / 2 END",
    "met_WindSpeedRot_mean_39": "CASE WHEN disc <> 3 THEN l_quantity / 4 END",
    "met_WinddirectionRot_mean_38": "CASE WHEN disc <> 4 THEN (price % 120) * 1.0e0 END",
    "met_WinddirectionRot_mean_39": "(price % 90) * 1.0e0",
}


def v_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results rows of many months: one per line item, stamped with its ship day."""
    li = table(spark, sf_dir, "lineitem")
    base = li.select(
        F.col("l_suppkey").alias("StationId"),
        F.col("l_shipdate").alias("TimeStamp"),
        tg.period_of(F.col("l_shipdate")).alias("period"),
        "l_quantity",
        whole("l_extendedprice").alias("price"),
        whole("l_discount").alias("disc"),
        whole("l_tax").alias("tax"),
    )
    return base.select("period", "StationId", "TimeStamp", *[F.expr(s).cast("double").alias(n) for n, s in RESULT_SQL.items()])


view(
    "v_result",
    'SELECT period, "StationId", "TimeStamp", '
    + ", ".join(f'{s} AS "{n}"' for n, s in RESULT_SQL.items())
    + """ FROM (SELECT l_suppkey AS "StationId", l_shipdate AS "TimeStamp", strftime(l_shipdate, '%Y-%m') AS period, l_quantity,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_discount * 100) AS BIGINT) AS disc,
  CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem) t""",
)
