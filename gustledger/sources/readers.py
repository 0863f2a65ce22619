"""Readers for monthly signal files, the alarm log, the lookups and the corrections.

A month of one kind is one text file ``<root>/<KIND>/<YYYY-MM>-<kind>.csv``.  The
month is taken from the file name into the column ``period``, so several months
are one DataFrame and every operator can keep them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustledger.functions import timegrid as tg
from gustledger.functions.nulls import nan_to_null
from gustledger.sources import schemas as S


def month_files(root: str, kind: str, periods: list[str] | None) -> list[str]:
    folder = f"{root.rstrip('/')}/{kind.upper()}"
    return [f"{folder}/{p}-{kind}.csv" for p in periods] if periods else [f"{folder}/*-{kind}.csv"]


def read_signal(spark: SparkSession, root: str, kind: str, periods: list[str] | None = None) -> DataFrame:
    """Raw monthly files of one kind; a month that is asked for and absent is an error."""
    wanted = S.ALARM_SCHEMA if kind == "sum" else S.signal_schema(kind)
    paths = month_files(root, kind, periods)
    text = spark.read.option("header", True).option("escape", '"')
    # Columns may stand in any order: their names come from the header of the first file, and a
    # file whose header differs is refused instead of being read by position.
    types = {f.name: f.dataType for f in wanted}
    header = text.csv(paths).columns
    layout = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in header])
    raw = text.schema(layout).option("enforceSchema", False).csv(paths)
    month = F.regexp_extract("_metadata.file_path", rf"(\d{{4}}-\d{{2}})-{kind}\.csv", 1)
    return raw.select(*[n for n in wanted.names if n in header], month.alias("period"))


def load_signal(raw: DataFrame, kind: str) -> DataFrame:
    """One signal table with parsed stamps and without NaN."""
    columns = [c for c in S.SIGNAL_COLUMNS[kind] if c in raw.columns]
    extra = [c for c in ("period",) if c in raw.columns]
    return nan_to_null(
        raw.select(F.col("TimeStamp").cast("timestamp_ntz").alias("TimeStamp"), "StationId", *columns, *extra)
    )


def load_alarms(raw: DataFrame, first_station: int = S.FIRST_STATION, last_station: int = S.LAST_STATION) -> DataFrame:
    """Alarm log of the farm's turbines with parsed times; unreadable times become NULL."""
    extra = [c for c in ("period",) if c in raw.columns]
    return (
        raw.where(F.col("Alarmcode").isNotNull() & F.col("StationNr").between(first_station, last_station))
        .select(
            "ID",
            tg.parse_time(F.col("TimeOn")).alias("TimeOn"),
            tg.parse_time(F.col("TimeOff")).alias("TimeOff"),
            "StationNr",
            F.col("Alarmcode").cast("int").alias("Alarmcode"),
            F.replace(F.col("Parameter"), F.lit(" "), F.lit("")).alias("Parameter"),
            *extra,
        )
    )


def pivot_met(
    met: DataFrame,
    masts=S.MASTS,
    sensors=("met_WindSpeedRot_mean", "met_WinddirectionRot_mean"),
) -> DataFrame:
    """One row per stamp with a column ``<sensor>_<mast>`` for every sensor and mast.

    The masts are given, so this is one conditional aggregate and no job runs to find them.
    """
    keys = [c for c in ("period", "TimeStamp") if c in met.columns]
    return (
        met.where(F.col("StationId").isin(*masts))
        .groupBy(*keys)
        .agg(
            *[
                F.avg(F.when(F.col("StationId") == mast, F.col(sensor))).alias(f"{sensor}_{mast}")
                for sensor in sensors
                for mast in masts
            ]
        )
    )


def load_all(
    spark: SparkSession, root: str, periods: list[str] | None = None, masts=S.MASTS,
    first_station: int = S.FIRST_STATION, last_station: int = S.LAST_STATION,
) -> dict[str, DataFrame]:
    """The seven input tables of the months, as lazy DataFrames; alarms of the given stations."""
    frames = {k: load_signal(read_signal(spark, root, k, periods), k) for k in ("tur", "cnt", "grd", "din", "flg")}
    frames["met"] = pivot_met(load_signal(read_signal(spark, root, "met", periods), "met"), masts)
    frames["sum"] = load_alarms(read_signal(spark, root, "sum", periods), first_station, last_station)
    return frames


def alarm_code_dim(raw: DataFrame, stopping_only: bool = False, order: str | None = None) -> DataFrame:
    """Alarm codes, one row per code: the first by ``order`` (default: by type and text)."""
    code = F.col("Number").cast("int").alias("Alarmcode")
    kind = F.col("Error Type").cast("int").alias("Error Type")
    rank = F.struct(F.col(order)) if order else F.struct(F.coalesce(F.col("Error Type"), F.lit(9e9)), F.col("UK Text"))
    first = F.min_by(F.struct("Error Type", "UK Text"), "rank")
    dim = (
        raw.select(code, kind, "UK Text", rank.alias("rank"))
        .groupBy("Alarmcode")
        .agg(first.alias("row"))
        .select("Alarmcode", "row.*")
    )
    return dim.where(F.col("Error Type").isin(*S.STOPPING_TYPES)) if stopping_only else dim


def read_alarm_codes(spark: SparkSession, path: str, stopping_only: bool = False) -> DataFrame:
    """Alarm codes of a file; of a code listed twice the first line counts."""
    raw = spark.read.schema(S.CODE_SCHEMA).option("header", True).csv(path)
    return alarm_code_dim(raw.withColumn("_line", F.monotonically_increasing_id()), stopping_only, order="_line")


def read_adjustments(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Correction list, one row per entry with its place in the list (``pos``).

    A file holds one document, or with ``one_document=False`` one document per line.
    """
    document = spark.read.schema(S.ADJUSTMENT_DOCUMENT).option("multiLine", one_document).json(path)
    entries = document.select(F.posexplode("adjustments").alias("_at", "entry"))
    # Grows along the lists and from one document to the next, so the last entry of an id is the last one read.
    return entries.select(F.monotonically_increasing_id().alias("pos"), "entry.*")


def power_curve(raw: DataFrame) -> DataFrame:
    """Knots of the curve, at any wind speeds; repeated rows collapse."""
    return raw.select(F.col("Wind").cast("double").alias("Wind"), F.col("Power").cast("double").alias("Power")).distinct()


def wind_distribution(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("bin").cast("int").alias("bin"), F.col("value").cast("double").alias("value"))


def season_factor(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("month").cast("int").alias("month"), F.col("value").cast("double").alias("value"))


def periods_within(df: DataFrame, periods: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Months by list, or else by first and last day; on a partitioned table this prunes folders."""
    month = F.col("period")
    if periods:
        return df.where(month.isin(*periods))
    if start:
        df = df.where(month >= start[:7])
    if end:
        df = df.where(month <= end[:7])
    return df


def read_results(spark: SparkSession, path: str, periods: list[str] | None = None) -> DataFrame:
    """Stored results of one or more months."""
    return periods_within(spark.read.parquet(path), periods)
