"""The station x stamp grid and the joins of the signal tables on it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg

CELL = ["period", "StationId", "TimeStamp"]
PLACE = "_place"


def place_rows(rows: DataFrame) -> DataFrame:
    """Move rows to the task of their station and month, whose number is added as ``_place``.

    Frames placed like this are joined on ``[PLACE, *CELL]`` and run through windows over a station's month
    (with ``PLACE`` among their keys) where they are: nothing is shuffled again. Key types may differ between frames.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.hash(F.col("period").cast("string"), F.col("StationId").cast("long")), F.lit(tasks))
    return rows.withColumn(PLACE, place).repartitionById(tasks, F.col(PLACE))


def station_range(spark, first: int, last: int) -> DataFrame:
    """The farm's station numbers as a table."""
    return spark.range(first, last + 1).withColumnRenamed("id", "StationId")


def period_end(counter: DataFrame) -> DataFrame:
    """Per month its start and its latest counter stamp; one row per month."""
    return (
        counter.groupBy("period")
        .agg(F.max("TimeStamp").alias("period_end"))
        .select("period", tg.period_start(F.col("period")).alias("period_start"), "period_end")
    )


def make_grid(stations: DataFrame, bounds: DataFrame, step: timedelta = tg.TEN_MINUTES, placed: bool = False) -> DataFrame:
    """Every station at every stamp of every month, with the station list's other columns.

    Days are laid out first and spread over the cluster; each task then fills in the
    stamps of its station-days, so a long range is not produced by a few tasks.
    Months are carried to the stations inside an array: a month list has a row per
    calendar month, and no join without a key is planned. ``placed`` spreads the days by
    :func:`place_rows`, so that the cells need no shuffle of their own.
    """
    months = bounds.agg(F.collect_list(F.struct("period", "period_start", "period_end")).alias("months")).scalar()
    day = timedelta(days=1)
    days = (
        stations.select("*", F.inline(months))
        .where(F.col("period_start") <= F.col("period_end"))
        .withColumn("_day", F.explode(tg.stamps(tg.ceil_to(F.col("period_start"), step), F.col("period_end"), max(day, step))))
    )
    days = place_rows(days) if placed else days.repartition("StationId", "_day")
    kept = [*stations.columns, PLACE] if placed else stations.columns
    last = F.least(tg.plus(F.col("_day"), max(day, step) - timedelta(microseconds=1)), F.col("period_end"))
    return days.select("period", *kept, F.explode(tg.stamps(F.col("_day"), last, step)).alias("TimeStamp"))


def expand_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """All grid cells, with the data of ``df`` where there is some."""
    if "StationNr" in df.columns:
        df = df.withColumnRenamed("StationNr", "StationId")
    return grid.join(df, CELL, "left")


def join_signals(cells: DataFrame, frames: list[DataFrame], met: DataFrame | None = None) -> DataFrame:
    """Left-join signal tables on the cell key, and mast data on the stamp alone.

    All cell joins use one key, so the cells are shuffled once for the whole chain. Placed cells
    are not shuffled at all: each table comes to them by :func:`place_rows`.
    """
    placed = PLACE in cells.columns
    for frame in frames:
        cells = cells.join(place_rows(frame), [PLACE, *CELL], "left") if placed else cells.join(frame, CELL, "left")
    return cells if met is None else cells.join(met, ["period", "TimeStamp"], "left")
