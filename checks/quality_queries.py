"""Queries over the data-quality operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from checks import views as V
from checks.folders import fresh_folder
from checks.registry import query, view
from gustledger.functions import timegrid as tg
from gustledger.operators import quality as Q
from gustledger.plans import scan
from gustledger.sources import schemas as S
from gustledger.sources import state, writers

FIRST, LAST = "2024-01-01 00:00:00", "2024-01-05 08:00:00"
EXPECTED = 625
view("v_stamps", f"SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 10 MINUTE)) AS \"TimeStamp\"")


def met(spark, d):
    return V.v_signal(spark, d, "met")


def ranges(spark, d, last=LAST):
    return (
        V.v_cell(spark, d).select("period").distinct().select(
            "period", tg.ntz(FIRST).alias("range_start"), tg.ntz(last).alias("range_end")
        )
    )


def issue_text(issues):
    """Issues with their list of stamps as one text."""
    return issues.withColumn("missing_timestamps", F.array_join("missing_timestamps", ",")).withColumn(
        "sample_value", F.round("sample_value", 6)
    )


# ------------------------------------------------------------- completeness

# All rows, with a daily hour in which the site's clock is off (its rows fall beside the grid) and a daily outage of one sensor.
def outage(spark, d):
    ts, hour = F.col("TimeStamp"), F.hour("TimeStamp")
    rows = met(spark, d).withColumn("TimeStamp", F.when(hour == 10, tg.plus(ts, timedelta(minutes=65))).otherwise(ts))
    for stat in S.STATISTICS:
        name = f"met_Pressure_{stat}"
        rows = rows.withColumn(name, F.when(hour != 15, F.col(name)))
    return rows


_DARK = ", ".join(f'CASE WHEN hour("TimeStamp") <> 15 THEN "met_Pressure_{s}" END AS "met_Pressure_{s}"' for s in S.STATISTICS)
view("v_outage", f"""SELECT * REPLACE ({_DARK}, CASE WHEN hour("TimeStamp") = 10 THEN "TimeStamp" + INTERVAL 65 MINUTE ELSE "TimeStamp" END AS "TimeStamp") FROM v_met""", "v_met")


@query(
    "completeness",
    f"""SELECT '2024-01' AS period, CAST({EXPECTED} - n AS BIGINT) AS missing_count, CAST({EXPECTED} AS BIGINT) AS total_expected,
  round((1 - ({EXPECTED} - n) / {EXPECTED}.0e0) * 100, 2) AS completeness_percentage
  FROM (SELECT count(DISTINCT "TimeStamp") AS n FROM v_stamps WHERE "TimeStamp" IN (SELECT "TimeStamp" FROM v_outage)) x""",
    ["v_stamps", "v_outage"],
)
def completeness(spark, d):
    return Q.completeness(outage(spark, d), ranges(spark, d))


_BY_STATION = """SELECT '2024-01' AS period, "StationId", CAST({e} - n AS BIGINT) AS missing_count, CAST({e} AS BIGINT) AS total_expected,
  round((1 - ({e} - n) / {e}.0e0) * 100, 2) AS completeness_percentage
  FROM (SELECT "StationId", count(DISTINCT "TimeStamp") FILTER (WHERE "TimeStamp" < TIMESTAMP '2024-01-03') AS n FROM v_met GROUP BY 1) x"""


@query("completeness_export", _BY_STATION.format(e=288), ["v_met"])
def completeness_export(spark, d):
    return Q.completeness(met(spark, d), ranges(spark, d, "2024-01-03 00:00:00"), by=("StationId",), end_inclusive=False)


view(
    "v_station_missing",
    """SELECT '2024-01' AS period, s."StationId", t."TimeStamp" FROM (SELECT DISTINCT "StationId" FROM v_met) s, v_stamps t
  WHERE (s."StationId", t."TimeStamp") NOT IN (SELECT ("StationId", "TimeStamp") FROM v_met)""",
    "v_met", "v_stamps",
)


@query("missing_timestamps", "SELECT * FROM v_station_missing", ["v_station_missing"])
def missing_timestamps(spark, d):
    return Q.missing_timestamps(met(spark, d), ranges(spark, d), by=("StationId",))


@query(
    "set_difference",
    """SELECT '2024-01' AS period, "TimeStamp" FROM v_stamps EXCEPT SELECT '2024-01', "TimeStamp" FROM v_outage""",
    ["v_stamps", "v_outage"],
)
def set_difference(spark, d):
    return Q.missing_timestamps(outage(spark, d), ranges(spark, d))


FIRST_TEN = """SELECT {keys}, count(*) AS count, string_agg(iso, ',' ORDER BY iso) FILTER (WHERE rn <= 10)
  || CASE WHEN count(*) > 10 THEN ',... and ' || (count(*) - 10) || ' more' ELSE '' END AS missing_timestamps
  FROM (SELECT *, strftime("TimeStamp", '%Y-%m-%dT%H:%M:%S') AS iso, row_number() OVER (PARTITION BY {keys} ORDER BY "TimeStamp") AS rn FROM {source}) x GROUP BY {keys}"""


@query("first_ten_missing", FIRST_TEN.format(keys='period, "StationId"', source="v_station_missing"), ["v_station_missing"])
def first_ten_missing(spark, d):
    missing = Q.missing_timestamps(met(spark, d), ranges(spark, d), by=("StationId",))
    out = Q.first_ten(missing, ["period", "StationId"])
    return out.withColumn("missing_timestamps", F.array_join("missing_timestamps", ","))


view("v_empty_stamp", 'SELECT "TimeStamp" FROM v_stamps WHERE "TimeStamp" NOT IN (SELECT "TimeStamp" FROM v_outage)', "v_stamps", "v_outage")
view(
    "v_sensor_missing",
    " UNION ALL ".join(
        f"""SELECT '2024-01' AS period, '{s}' AS sensor, "TimeStamp" FROM v_stamps WHERE "TimeStamp" NOT IN (SELECT "TimeStamp" FROM v_outage WHERE "{s}_mean" IS NOT NULL)
    AND "TimeStamp" NOT IN (SELECT "TimeStamp" FROM v_empty_stamp)"""
        for s in S.MET_SENSORS
    ),
    "v_stamps", "v_outage", "v_empty_stamp",
)
view(
    "v_system_missing",
    "SELECT * FROM v_sensor_missing UNION ALL SELECT '2024-01', 'Global Connectivity', \"TimeStamp\" FROM v_empty_stamp",
    "v_sensor_missing", "v_empty_stamp",
)


@query("sensor_only_gaps", "SELECT * FROM v_sensor_missing", ["v_sensor_missing"])
def sensor_only_gaps(spark, d):
    return Q.sensor_only_gaps(outage(spark, d), ranges(spark, d)).select("period", "sensor", "TimeStamp")


def issue_sql(fields: dict[str, str], source: str) -> str:
    """Issue columns in full, NULL where a type has none."""
    kinds = {"count": "BIGINT", "total_expected": "BIGINT", "completeness_pct": "DOUBLE", "range_start": "TIMESTAMP", "range_end": "TIMESTAMP",
             "sample_value": "DOUBLE", "bound_low": "DOUBLE", "bound_high": "DOUBLE"}
    cells = ", ".join(f"CAST({fields.get(n, 'NULL')} AS {kinds.get(n, 'VARCHAR')}) AS \"{n}\"" for n in Q.ISSUE_FIELDS)
    return f"SELECT {cells} FROM {source}"


_COMPLETE = {
    "count": "count", "total_expected": str(EXPECTED), "completeness_pct": f"round((1 - count / {EXPECTED}.0e0) * 100, 2)",
    "missing_timestamps": "missing_timestamps", "range_start": f"TIMESTAMP '{FIRST}'", "range_end": f"TIMESTAMP '{LAST}'", "period": "period",
}
SYSTEM_ISSUES = issue_sql(
    {**_COMPLETE, "type": "'system_completeness'", "station_id": "'ALL'", "sensor": "sensor"},
    "(" + FIRST_TEN.format(keys="period, sensor", source="v_system_missing") + ") y",
)
STATION_ISSUES = issue_sql(
    {**_COMPLETE, "type": "'completeness'", "station_id": '"StationId"'},
    "(" + FIRST_TEN.format(keys='period, "StationId"', source="v_outage_station_missing") + ") y",
)
view(
    "v_outage_station_missing",
    """SELECT '2024-01' AS period, s."StationId", t."TimeStamp" FROM (SELECT DISTINCT "StationId" FROM v_outage) s, v_stamps t
  WHERE (s."StationId", t."TimeStamp") NOT IN (SELECT ("StationId", "TimeStamp") FROM v_outage)""",
    "v_outage", "v_stamps",
)


@query("system_completeness", SYSTEM_ISSUES, ["v_system_missing"])
def system_completeness(spark, d):
    return issue_text(Q.system_completeness(outage(spark, d), ranges(spark, d)))


@query("station_completeness", STATION_ISSUES, ["v_outage_station_missing"])
def station_completeness(spark, d):
    return issue_text(Q.station_completeness(outage(spark, d), ranges(spark, d)))


# ------------------------------------------------------------- value checks

_MEANS = [f'"{s}_mean"' for s in S.MET_SENSORS]
_EMPTY = " AND ".join(f"{m} IS NULL" for m in _MEANS)


def count_sql(kind: str, where: str, source: str, **more) -> str:
    fields = {"period": "period", "type": f"'{kind}'", "station_id": '"StationId"', "count": "count(*)",
              "range_start": 'min("TimeStamp")', "range_end": 'max("TimeStamp")', **more}
    return issue_sql(fields, f'{source} WHERE {where} GROUP BY period, "StationId"')


def empty_sql(source):
    return count_sql("empty_row", _EMPTY, source, sensor="'ALL'")


def gaps_sql(source):
    return " UNION ALL ".join(
        count_sql("sensor_gap", f'"{s}_mean" IS NULL AND NOT ({_EMPTY})', source, sensor=f"'{s}'") for s in S.MET_SENSORS
    )


def ranges_sql(source):
    return " UNION ALL ".join(
        count_sql(
            "out_of_range", f'NOT ("{b}_{s}" BETWEEN {lo} AND {hi})', source, column=f"'{b}_{s}'",
            bound_low=str(lo), bound_high=str(hi),
        )
        for b, (lo, hi) in S.MET_BOUNDS.items()
        for s in ("mean", "min", "max")
    )


def stuck_rows_sql(source: str, base: str, n: int = 3, exclude_zero: bool = False) -> str:
    """Rows with the flag, by numbering runs of repeats and counting them."""
    same = " AND ".join(
        f'coalesce("{base}_{s}" = lag("{base}_{s}") OVER (PARTITION BY period, "StationId" ORDER BY "TimeStamp"), false)' for s in S.STATISTICS
    )
    if exclude_zero:
        same += f' AND coalesce("{base}_mean" <> 0, false)'
    return f"""SELECT *, count(*) OVER (PARTITION BY period, "StationId", run) >= {n} AS stuck FROM (
    SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY period, "StationId" ORDER BY "TimeStamp" ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, {same} AS same FROM {source}) a) b"""


def stuck_sql(source, n=3, exclude_zero=False):
    return " UNION ALL ".join(
        count_sql(
            "stuck_value", "stuck", f"({stuck_rows_sql(source, b, n, exclude_zero)}) c", sensor=f"'{b}'",
            sample_value=f'round(arg_min("{b}_mean", "TimeStamp"), 6)',
        )
        for b in S.MET_SENSORS
    )


@query("empty_rows", empty_sql("v_met"), ["v_met"])
def empty_rows(spark, d):
    return issue_text(Q.empty_rows(met(spark, d)))


@query("sensor_gaps", gaps_sql("v_met"), ["v_met"])
def sensor_gaps(spark, d):
    return issue_text(Q.sensor_gaps(met(spark, d)))


@query("range_issues", ranges_sql("v_met"), ["v_met"])
def range_issues(spark, d):
    return issue_text(Q.range_issues(met(spark, d)))


@query("stuck_issues", stuck_sql("v_met", 2), ["v_met"])
def stuck_issues(spark, d):
    return issue_text(Q.stuck_issues(met(spark, d), 2))


_FLAG = 'SELECT "StationId", "TimeStamp", stuck FROM ({rows})'


@query("stuck_flag", _FLAG.format(rows=stuck_rows_sql("v_met", "met_WindSpeedRot", 3)), ["v_met"])
def stuck_flag(spark, d):
    return Q.stuck_flag(met(spark, d), "met_WindSpeedRot", 3).select("StationId", "TimeStamp", "stuck")


@query("stuck_flag_exclude_zero", _FLAG.format(rows=stuck_rows_sql("v_met", "met_WindSpeedRot", 2, True)), ["v_met"])
def stuck_flag_exclude_zero(spark, d):
    return Q.stuck_flag(met(spark, d), "met_WindSpeedRot", 2, True).select("StationId", "TimeStamp", "stuck")


_NULLED = ", ".join(
    f'CASE WHEN NOT k_{b}.stuck' + (f' AND k_{b}."{b}_{s}" BETWEEN {lo} AND {hi}' if s != "stddev" else "") + f' THEN k_{b}."{b}_{s}" END AS "{b}_{s}"'
    for b, (lo, hi) in S.MET_BOUNDS.items()
    for s in S.STATISTICS
)
_FLAGGED = " ".join(
    f'JOIN ({stuck_rows_sql("v_met", b)}) k_{b} ON k_{b}."StationId" = m."StationId" AND k_{b}."TimeStamp" = m."TimeStamp"' for b in S.MET_SENSORS
)


@query("nullify_met", f'SELECT m.period, m."StationId", m."TimeStamp", {_NULLED} FROM v_met m {_FLAGGED}', ["v_met"])
def nullify_met(spark, d):
    return Q.nullify_met(met(spark, d))


# ---------------------------------------------------------------- the scan

ALL_ISSUES = f"{SYSTEM_ISSUES} UNION ALL {STATION_ISSUES} UNION ALL {empty_sql('v_outage')} UNION ALL {gaps_sql('v_outage')} UNION ALL {stuck_sql('v_outage')} UNION ALL {ranges_sql('v_outage')}"
_SCAN_VIEWS = ["v_system_missing", "v_outage_station_missing", "v_outage"]


def scanned(spark, d):
    """The scan of a stored table with the clock just after the last stamp, as in a month still running."""
    path = fresh_folder(spark)
    writers.write_partitioned(outage(spark, d), path)
    return scan.validation_scan(spark.read.parquet(path), LAST, manifest=state.month_manifest(spark, path))


@query("scan_met", ALL_ISSUES, _SCAN_VIEWS)
def scan_met(spark, d):
    return issue_text(scanned(spark, d)[0])


@query(
    "issue_summary",
    f"""SELECT CAST(1 AS BIGINT) AS total_files_scanned, count(*) AS total_issues, count(DISTINCT period) AS files_with_issues,
  count(*) FILTER (WHERE type = 'stuck_value') AS stuck_values_count, count(*) FILTER (WHERE type = 'out_of_range') AS out_of_range_count,
  count(*) FILTER (WHERE type = 'completeness') AS completeness_issues_count, count(*) FILTER (WHERE type = 'system_completeness') AS system_issues_count,
  count(*) FILTER (WHERE type = 'empty_row') AS empty_rows_count, count(*) FILTER (WHERE type = 'sensor_gap') AS sensor_gaps_count FROM ({ALL_ISSUES}) z""",
    _SCAN_VIEWS,
)
def issue_summary(spark, d):
    return scanned(spark, d)[1]


@query(
    "issue_severity_order",
    f"""SELECT type, station_id, sensor, "column", count, CASE WHEN type = 'system_completeness' THEN CASE WHEN sensor = 'Global Connectivity' THEN 0 ELSE 1 END
  WHEN type = 'completeness' THEN 2 WHEN type = 'empty_row' THEN 2.5 WHEN type = 'sensor_gap' THEN 2.8 WHEN type = 'stuck_value' THEN 3 ELSE 4 END::DOUBLE AS severity
  FROM ({ALL_ISSUES}) z ORDER BY severity, station_id, sensor, "column" """,
    _SCAN_VIEWS,
)
def issue_severity_order(spark, d):
    return Q.order_issues(scanned(spark, d)[0]).select("type", "station_id", "sensor", "column", "count", "severity")


@query(
    "effective_scan_range",
    """SELECT period, greatest(ms, TIMESTAMP '1996-03-10') AS range_start, least(me, TIMESTAMP '2000-06-20 23:59:59') AS range_end
  FROM (SELECT period, strptime(period || '-01', '%Y-%m-%d') AS ms, strptime(period || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS me
    FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period FROM orders) a) b
  WHERE greatest(ms, TIMESTAMP '1996-03-10') <= least(me, TIMESTAMP '2000-06-20 23:59:59')""",
)
def effective_scan_range(spark, d):
    months = V.table(spark, d, "orders").select(tg.period_of(F.col("o_orderdate")).alias("period"))
    return scan.scan_ranges(months, "2001-12-31 00:00:00", "1996-03-10 00:00:00", "2000-06-20 00:00:00")
