"""Queries over readers, writers, extracts and date helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.adjustment_queries import DATE_TEXT, LIST, v_adjust
from checks.energy_queries import KEY_SQL
from checks.kpi_queries import GROUPED_SQL, grouped
from checks.quality_queries import _SCAN_VIEWS, ALL_ISSUES, LAST, outage
from checks.folders import fresh_folder
from checks.registry import query, view
from gustledger.functions import timegrid as tg
from gustledger.functions.nulls import row_hash
from gustledger.functions.numbers import decimal_comma
from gustledger.operators import kpi as K
from gustledger.operators import quality as Q
from gustledger.plans.scan import scan_report
from gustledger.plans.settle import settle
from gustledger.sources import readers, state, writers
from gustledger.sources import schemas as S


def store(df, root: str, kind: str) -> None:
    """Write a month as text in the layout of the readers, compressed."""
    df.drop("period").write.option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{root}/{kind.upper()}/2024-01-{kind}.csv")


def stamped(df):
    return df.withColumn("TimeStamp", F.col("TimeStamp").cast("string"))


def stored_signal(spark, d, kind):
    root = fresh_folder(spark)
    store(stamped(V.v_signal(spark, d, kind)), root, kind)
    return root


# ------------------------------------------------------------------ signals

_GRD = 'period, "StationId", CAST("TimeStamp" AS VARCHAR) AS "TimeStamp", "wtc_ActPower_min", "wtc_ActPower_max", "wtc_ActPower_mean"'


@query("read_signal_csv", f"SELECT {_GRD} FROM v_grd", ["v_grd"])
def read_signal_csv(spark, d):
    return readers.read_signal(spark, stored_signal(spark, d, "grd"), "grd", ["2024-01"])


def loader(name: str, kind: str):
    @query(name, f"SELECT * FROM v_{kind}", [f"v_{kind}"])
    def run(spark, d):
        return readers.load_signal(readers.read_signal(spark, stored_signal(spark, d, kind), kind), kind)

    return run


for _name, _kind in (
    ("load_grid", "grd"), ("load_counter", "cnt"), ("load_turbine", "tur"), ("load_digital_input", "din"), ("load_flag", "flg"),
):
    loader(_name, _kind)


# ------------------------------------------------------------------- alarms

def raw_alarms(spark, d):
    """The log as text: whole seconds or fractions, some codes missing, some ends unreadable."""
    ev = V.table(spark, d, "events")
    stamp = F.col("ts").cast("string")
    return V.v_alarm(spark, d).join(ev.select(F.col("event_id").alias("ID"), stamp.alias("stamp")), "ID").select(
        "ID",
        F.when(F.col("ID") % 2 == 0, F.col("stamp")).otherwise(F.substring("stamp", 1, 19)).alias("TimeOn"),
        F.when(F.col("ID") % 50 == 1, "not yet").otherwise(F.col("TimeOff").cast("string")).alias("TimeOff"),
        "StationNr",
        F.when(F.col("ID") % 19 != 0, F.col("Alarmcode").cast("double")).alias("Alarmcode"),
        "Parameter",
    )


# The reader keeps microseconds, with or without them in the text.
view(
    "v_loaded",
    """SELECT v."ID", CASE WHEN v."ID" % 2 = 0 THEN e.ts ELSE date_trunc('second', e.ts) END AS "TimeOn",
  CASE WHEN v."ID" % 50 <> 1 THEN v."TimeOff" END AS "TimeOff", v."StationNr", CASE WHEN v."ID" % 19 <> 0 THEN v."Alarmcode" END AS "Alarmcode",
  replace(v."Parameter", ' ', '') AS "Parameter" FROM v_alarm v JOIN events e ON e.event_id = v."ID" """,
    "v_alarm",
)
_LOADED = '"ID", "TimeOn", "TimeOff", "StationNr", "Alarmcode", "Parameter"'


def loaded(spark, d, first=20, last=119):
    return readers.load_alarms(raw_alarms(spark, d), first, last)


@query("load_alarms", f'SELECT {_LOADED}, \'2024-01\' AS period FROM v_loaded WHERE "Alarmcode" IS NOT NULL', ["v_loaded"])
def load_alarms(spark, d):
    """The stored log of the stations that the alarms themselves name."""
    root = fresh_folder(spark)
    store(raw_alarms(spark, d), root, "sum")
    named = V.v_alarm(spark, d).agg(F.min("StationNr").alias("first"), F.max("StationNr").alias("last")).first()
    return readers.load_alarms(readers.read_signal(spark, root, "sum"), named["first"], named["last"])


@query("drop_null_code", 'SELECT "ID", "Alarmcode" FROM v_loaded WHERE "Alarmcode" IS NOT NULL', ["v_loaded"])
def drop_null_code(spark, d):
    return loaded(spark, d, 0, 10**9).select("ID", "Alarmcode")


@query("parse_two_formats", 'SELECT "ID", "TimeOn", "TimeOff" FROM v_loaded', ["v_loaded"])
def parse_two_formats(spark, d):
    return raw_alarms(spark, d).select(
        "ID", tg.parse_time(F.col("TimeOn")).alias("TimeOn"), tg.parse_time(F.col("TimeOff")).alias("TimeOff")
    )


@query("station_range", 'SELECT "ID", "StationNr" FROM v_loaded WHERE "Alarmcode" IS NOT NULL AND "StationNr" >= 50 AND "StationNr" <= 90', ["v_loaded"])
def station_range(spark, d):
    return loaded(spark, d, 50, 90).select("ID", "StationNr")


@query("strip_blanks", 'SELECT "ID", "Parameter" FROM v_loaded WHERE "Alarmcode" IS NOT NULL', ["v_loaded"])
def strip_blanks(spark, d):
    return loaded(spark, d, 0, 10**9).select("ID", "Parameter")


@query(
    "load_all",
    """SELECT 'sum' AS kind, count(*) AS row_count, count(DISTINCT "StationNr") AS stations FROM v_loaded WHERE "Alarmcode" IS NOT NULL
  UNION ALL SELECT 'met', count(DISTINCT "TimeStamp"), CAST(1 AS BIGINT) FROM v_mast
  UNION ALL SELECT 'grd', count(*), count(DISTINCT "StationId") FROM v_grd UNION ALL SELECT 'cnt', count(*), count(DISTINCT "StationId") FROM v_cnt
  UNION ALL SELECT 'tur', count(*), count(DISTINCT "StationId") FROM v_tur UNION ALL SELECT 'din', count(*), count(DISTINCT "StationId") FROM v_din
  UNION ALL SELECT 'flg', count(*), count(DISTINCT "StationId") FROM v_flg""",
    ["v_loaded", "v_mast", "v_grd", "v_cnt", "v_tur", "v_din", "v_flg"],
)
def load_all(spark, d):
    root = fresh_folder(spark)
    # All signals of the check come from one table of cells: made once, read per signal.
    V.v_sig(spark, d).write.parquet(f"{root}/cells")
    cells = spark.read.parquet(f"{root}/cells")
    for kind in ("grd", "cnt", "tur", "din", "flg"):
        store(stamped(cells.select(*V.KEY, *V.values(kind))), root, kind)
    store(raw_alarms(spark, d), root, "sum")
    mast = V.v_mast(spark, d).select("period", "StationId", "TimeStamp", *[
        (F.col(c) if c in ("met_WindSpeedRot_mean", "met_WinddirectionRot_mean") else F.lit(None).cast("double")).alias(c)
        for c in S.SIGNAL_COLUMNS["met"]
    ])
    store(stamped(mast), root, "met")
    frames = readers.load_all(spark, root, ["2024-01"], first_station=0, last_station=10**9)
    out = None
    for kind, frame in frames.items():
        station = "StationNr" if kind == "sum" else "StationId"
        stations = F.count_distinct(station) if station in frame.columns else F.lit(1).cast("long")
        row = frame.agg(F.count(F.lit(1)).alias("row_count"), stations.alias("stations")).select(
            F.lit(kind).alias("kind"), "row_count", "stations"
        )
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------------ lookups

@query(
    "alarm_code_dim",
    """SELECT p_size AS "Alarmcode", CASE WHEN p_size % 3 < 2 THEN p_size % 3 END AS "Error Type", p_name AS "UK Text" FROM part
  WHERE p_size % 3 < 2 AND p_partkey = (SELECT min(q.p_partkey) FROM part q WHERE q.p_size = part.p_size)""",
)
def alarm_code_dim(spark, d):
    raw = V.table(spark, d, "part").select(
        F.col("p_size").cast("double").alias("Number"),
        F.when(F.col("p_size") % 3 < 2, F.col("p_size") % 3).cast("double").alias("Error Type"),
        F.col("p_name").alias("UK Text"),
        F.col("p_partkey").alias("line"),
    )
    return readers.alarm_code_dim(raw, stopping_only=True, order="line")


@query(
    "lookup_tables",
    """SELECT 'curve' AS name, "Wind" AS key, CAST("Power" AS DOUBLE) AS value FROM v_curve
  UNION ALL SELECT 'distribution', bin, value FROM v_distribution UNION ALL SELECT 'season', month, value FROM v_season""",
    ["v_curve", "v_distribution", "v_season"],
)
def lookup_tables(spark, d):
    parts = (
        ("curve", readers.power_curve(V.v_curve(spark, d)), "Wind", "Power"),
        ("distribution", readers.wind_distribution(V.v_distribution(spark, d)), "bin", "value"),
        ("season", readers.season_factor(V.v_season(spark, d)), "month", "value"),
    )
    out = None
    for name, df, key, value in parts:
        row = df.select(F.lit(name).alias("name"), F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


@query("adjustment_json", "SELECT id, alarm_code, station_nr, time_on, time_off, notes FROM v_adjust", ["v_adjust"])
def adjustment_json(spark, d):
    """Documents of at most 64 corrections each, by place in the list."""
    entry = F.struct(*[c for c in LIST if c != "pos"])
    part = V.div(F.col("pos"), 64).alias("part")
    documents = v_adjust(spark, d).groupBy(part).agg(F.collect_list(entry).alias("adjustments")).select("adjustments")
    path = fresh_folder(spark)
    documents.write.json(path)
    return readers.read_adjustments(spark, path, one_document=False).select(
        "id", "alarm_code", "station_nr", "time_on", "time_off", "notes"
    )


# ------------------------------------------------------------- months, files

@query(
    "month_file_filter",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1996-03' AND '1997-02'
  UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1995-05', '1999-01')""",
)
def month_file_filter(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", tg.period_of(F.col("o_orderdate")).alias("period"))
    return readers.periods_within(o, start="1996-03-20", end="1997-02-05").unionByName(
        readers.periods_within(o, ["1995-05", "1999-01"])
    )


_RESULT = 'period, "StationId", "TimeStamp", "EL", "ELX", "wtc_kWG1TotE_accum"'
_RESULT_COLS = ["period", "StationId", "TimeStamp", "EL", "ELX", "wtc_kWG1TotE_accum"]


def stored_results(spark, d):
    path = fresh_folder(spark)
    writers.write_partitioned(V.v_result(spark, d).select(*_RESULT_COLS), path)
    return path


@query(
    "write_results",
    'SELECT period, "StationId", "TimeStamp", round(CAST(CAST("EL" AS FLOAT) AS DOUBLE), 2) AS "EL", round(CAST(CAST("ELX" AS FLOAT) AS DOUBLE), 2) AS "ELX" FROM v_result',
    ["v_result"],
)
def write_results(spark, d):
    """Stored as 4-byte floats; two decimals survive."""
    path = fresh_folder(spark)
    writers.write_results(V.v_result(spark, d).select("period", "StationId", "TimeStamp", "EL", "ELX"), path)
    back = [F.round(F.col(c).cast("double"), 2).alias(c) for c in ("EL", "ELX")]
    return readers.read_results(spark, path).select("period", "StationId", "TimeStamp", *back)


@query("read_results_range", f"SELECT {_RESULT} FROM v_result WHERE period BETWEEN '1997-01' AND '1997-06'", ["v_result"])
def read_results_range(spark, d):
    months = [f"1997-{m:02d}" for m in range(1, 7)]
    return readers.read_results(spark, stored_results(spark, d), months).select(*_RESULT_COLS)


@query("union_months", f"SELECT {_RESULT} FROM v_result WHERE period IN ('1996-02', '1998-12')", ["v_result"])
def union_months(spark, d):
    return readers.read_results(spark, stored_results(spark, d), ["1996-02", "1998-12"]).select(*_RESULT_COLS)


@query(
    "write_signal",
    f"""SELECT {_RESULT} FROM v_result WHERE period <> '1997-03'
  UNION ALL SELECT period, "StationId", "TimeStamp", "EL" + 1, "ELX", "wtc_kWG1TotE_accum" FROM v_result WHERE period = '1997-03'""",
    ["v_result"],
)
def write_signal(spark, d):
    """Rewriting one month leaves the others as they were."""
    path = stored_results(spark, d)
    month = V.v_result(spark, d).select(*_RESULT_COLS).where(F.col("period") == "1997-03").withColumn("EL", F.col("EL") + 1)
    writers.write_partitioned(month, path)
    return spark.read.parquet(path).select(*_RESULT_COLS)


@query(
    "write_grouped",
    f"""SELECT CAST(row_number() OVER (PARTITION BY period ORDER BY "StationId") AS VARCHAR) AS "row", period, CAST("StationId" AS VARCHAR) AS "StationId",
  replace(CAST("ELX" AS VARCHAR), '.', ',') AS "ELX", replace(CAST("MAA_brut_mis" AS VARCHAR), '.', ',') AS "MAA_brut_mis" FROM ({GROUPED_SQL})""",
    ["v_result"],
)
def write_grouped(spark, d):
    table = K.numbered(grouped(spark, d).select("period", "StationId", "ELX", "MAA_brut_mis"))
    path = fresh_folder(spark)
    writers.write_grouped(table, path)
    return spark.read.option("header", True).csv(path)


@query(
    "write_issue_report",
    f"SELECT type, station_id, sensor, count, completeness_pct FROM ({ALL_ISSUES}) z",
    _SCAN_VIEWS,
)
def write_issue_report(spark, d):
    met, path = fresh_folder(spark), fresh_folder(spark)
    writers.write_partitioned(outage(spark, d), met)
    scan_report(spark.read.parquet(met), LAST, path, manifest=state.month_manifest(spark, met))
    return spark.read.schema(Q.ISSUE_SCHEMA).json(f"{path}/issues").select("type", "station_id", "sensor", "count", "completeness_pct")


# --------------------------------------------------------------- change state

def order_state(spark, d, changed: bool):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", tg.period_of(F.col("o_orderdate")).alias("period"))
    if changed:
        edited = (F.substring("period", 1, 4) == "1997") & (F.col("o_orderpriority") == "1-URGENT")
        return o.withColumn("o_custkey", F.when(edited, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return o.where(F.col("period") < "2000-01")


STATE_COLUMNS = ["odd", "even", "o_orderpriority"]


def order_pairs(spark, d, changed: bool):
    """Every order as two equal rows, its customer in one of two columns, the other one NULL.

    Changed: customers of urgent orders of 1997, in both rows alike; orders of 1996 whose customer
    moved to the other column. Months from 2000 on are not stored yet.
    """
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", tg.period_of(F.col("o_orderdate")).alias("period"))
    year, customer, even = F.substring("period", 1, 4), F.col("o_custkey"), F.col("o_orderkey") % 2 == 0
    if changed:
        customer = F.when((year == "1997") & (F.col("o_orderpriority") == "1-URGENT"), customer + 1).otherwise(customer)
        even = F.when((year == "1996") & (F.col("o_orderkey") % 7 == 0), ~even).otherwise(even)
    else:
        o = o.where(F.col("period") < "2000-01")
    placed = o.select("period", F.when(~even, customer).alias("odd"), F.when(even, customer).alias("even"), "o_orderpriority")
    return placed.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")


_PAIRS_SQL = """SELECT strftime(o_orderdate, '%Y-%m') AS period, 2 * count(*) AS n,
    count(*) FILTER (WHERE (year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT') OR (year(o_orderdate) = 1996 AND o_orderkey % 7 = 0)) AS edited FROM orders GROUP BY 1"""
_STATUS_SQL = """CASE WHEN s.period >= '2000-01' THEN 'METADATA_MISSING' WHEN s.edited = 0 THEN 'NO_CHANGE' ELSE 'CHANGE_DETECTED' END"""


@query(
    "state_checksum",
    f"SELECT s.period, s.n AS row_count, CASE WHEN s.period < '2000-01' THEN s.n END AS stored_count, {_STATUS_SQL} AS status FROM ({_PAIRS_SQL}) s",
)
def state_checksum(spark, d):
    now, stored = (state.state_checksum(order_pairs(spark, d, changed), STATE_COLUMNS, ["period"]) for changed in (True, False))
    return state.changed_periods(now, stored, ["period"])


@query(
    "state_by_file",
    f"""SELECT s.period, s.n AS row_count, s.period >= '2000-01' OR s.edited > 0 AS rewritten, s.edited = 0 AND s.period < '2000-01' AS carried, true AS merged FROM ({_PAIRS_SQL}) s""",
)
def state_by_file(spark, d):
    """States of files: a stored table gets its changed months rewritten, and only their files are read again."""
    path = fresh_folder(spark)
    writers.write_partitioned(order_pairs(spark, d, False), path)
    before = settle(state.file_states(spark, path, STATE_COLUMNS))
    now = order_pairs(spark, d, True)
    whole = state.state_checksum(now, STATE_COLUMNS, ["period"])
    months = state.changed_periods(whole, state.merge_states(before, ["period"]), ["period"]).where("status <> 'NO_CHANGE'")
    writers.write_partitioned(now.join(months, "period", "left_semi"), path)
    after = settle(state.file_states(spark, path, STATE_COLUMNS, before))
    carried = after.join(before, state.FILE, "left_semi").select("period").distinct().withColumn("carried", F.lit(True))
    merged = state.merge_states(after, ["period"]).withColumnRenamed("checksum", "_by_file").join(whole.drop("row_count"), "period")
    changed = months.select("period", F.lit(True).alias("rewritten"))
    return merged.join(changed, "period", "left").join(carried, "period", "left").select(
        "period", "row_count", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("rewritten", "carried")], (F.col("_by_file") == F.col("checksum")).alias("merged")
    )


@query(
    "state_metadata",
    f"""SELECT 'orders' AS "table", s.period, s.n AS row_count, CASE WHEN s.edited > 0 OR s.period >= '2000-01' THEN '2024-02-01' ELSE '2024-01-01' END AS last_updated,
  true AS current FROM ({_PAIRS_SQL}) s""",
)
def state_metadata(spark, d):
    """Two runs append their states; the last one of every month is the one that holds."""
    path = fresh_folder(spark)
    stored, now = (state.state_checksum(order_pairs(spark, d, changed), STATE_COLUMNS, ["period"]) for changed in (False, True))
    writers.append_state(stored.select(F.lit("orders").alias("table"), "*", F.lit("2024-01-01").alias("last_updated")), path)
    months = state.changed_periods(now, state.latest_state(spark.read.parquet(path)), ["period"]).where("status <> 'NO_CHANGE'")
    later = now.join(months, "period", "left_semi")
    writers.append_state(later.select(F.lit("orders").alias("table"), "*", F.lit("2024-02-01").alias("last_updated")), path)
    latest = state.latest_state(spark.read.parquet(path))
    return latest.join(now.select("period", F.col("checksum").alias("_now")), "period").select("table", "period", "row_count", "last_updated", (F.col("checksum") == F.col("_now")).alias("current"))


@query(
    "row_hash",
    "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || CAST(o_custkey AS VARCHAR) || o_orderstatus || CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END) AS hash FROM orders",
)
def hashes(spark, d):
    o = V.table(spark, d, "orders").withColumn("mark", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return o.select("o_orderkey", row_hash(["o_orderkey", "o_custkey", "o_orderstatus", "mark"]).alias("hash"))


@query(
    "flat_column_names",
    " UNION ALL ".join(
        f"""SELECT '{s}_{m}' AS name, count(DISTINCT "TimeStamp") FILTER (WHERE "StationId" = {m} AND "{s}" IS NOT NULL) AS stamps FROM v_mast"""
        for s in ("met_WindSpeedRot_mean", "met_WinddirectionRot_mean")
        for m in S.MASTS
    ),
    ["v_mast"],
)
def flat_column_names(spark, d):
    wide = readers.pivot_met(V.v_mast(spark, d)).drop("period")
    counts = wide.agg(*[F.count(c).alias(c) for c in wide.columns if c != "TimeStamp"])
    return counts.unpivot([], counts.columns, "name", "stamps")


# -------------------------------------------------------------- date helpers

@query(
    "month_bounds",
    """SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS first_instant, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS next_instant,
  (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 SECOND)::TIMESTAMP AS last_second FROM orders""",
)
def month_bounds(spark, d):
    p = tg.period_of(F.col("o_orderdate"))
    return V.table(spark, d, "orders").select(
        "o_orderkey", tg.period_start(p).alias("first_instant"), tg.next_period_start(p).alias("next_instant"), tg.month_end(p).alias("last_second")
    )


@query(
    "period_range",
    """SELECT o_custkey, strftime(unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', b)::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m') AS period
  FROM (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1) x""",
)
def period_range(spark, d):
    spans = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.select("o_custkey", F.explode(tg.periods_between(F.col("a"), F.col("b"))).alias("period"))


@query(
    "week_window",
    """SELECT event_id, date_trunc('day', ts)::TIMESTAMP - INTERVAL 6 DAY AS week_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL '23 hours 50 minutes' AS week_end FROM events""",
)
def week_window(spark, d):
    start, end = tg.week_window(F.col("ts"))
    return V.table(spark, d, "events").select("event_id", start.alias("week_start"), end.alias("week_end"))


@query(
    "days_in_range",
    "SELECT o_custkey, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS BIGINT) AS days FROM orders GROUP BY 1",
)
def days_in_range(spark, d):
    spans = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.select("o_custkey", tg.days_in_range(F.col("a"), F.col("b")).alias("days"))
