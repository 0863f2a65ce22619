"""Tiles of the station x stamp grid: blocks of neighbouring stations by stretches of time.

Losses look at the stations next to one, at the stamp before, and at all stations of a stamp. A tile
holds a few stations over a few hours, with a margin: a copy of one station at either end and of one
stamp before its own. Windows over a stamp and over a series then stay inside tiles, and a tile has
the same size whatever the number of stations and months. What concerns a whole stamp is aggregated
once and comes to every tile as one row per stamp.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg

#: Stations in a block, and time in a tile.
STATIONS = 16
WIDTH = timedelta(hours=6)
BLOCKS, STATION_BLOCK, TIME_BLOCK, COPY = "_blocks", "_station_block", "_time_block", "_copy"
TILE = ["period", STATION_BLOCK, TIME_BLOCK]


def station_blocks(stations: DataFrame, size: int = STATIONS) -> DataFrame:
    """Add ``_blocks``: the block of every station, then those that need a copy of it.

    Stations are numbered in order of their id by a window over the station list alone, one
    narrow row per turbine.
    """
    place = F.row_number().over(Window.orderBy("StationId")) - 1
    own = F.floor(place / size).cast("int")
    before = F.when((place % size == 0) & (place > 0), own - 1)
    after = F.when(place % size == size - 1, own + 1)
    return stations.withColumn(BLOCKS, F.array_compact(F.array(own, before, after)))


def _times(stamp: Column, step: timedelta, width: timedelta) -> Column:
    """The time block of a stamp, and the next one where the stamp is the last before it."""
    return F.array_distinct(F.array(tg.slot(stamp, width), tg.slot(tg.plus(stamp, step), width)))


def tiled(cells: DataFrame, stamps: DataFrame, blocks: Column, step: timedelta, margin: list[str], size_of_time: timedelta = WIDTH) -> DataFrame:
    """Cut cells with ``_blocks`` into tiles; ``stamps``, one row per month and stamp, goes to all of them.

    ``blocks`` is the array of all station blocks. Stations of the margin carry the columns ``margin``
    only. Rows of ``stamps`` have no station, so that they come first in their stamp; ``_copy`` marks
    them and the margins.
    """
    width = max(size_of_time, step)
    stamp = F.col("TimeStamp")
    own_block, own_time = F.col(BLOCKS)[0], tg.slot(stamp, width)
    rows = cells.withColumn(STATION_BLOCK, F.explode(BLOCKS)).withColumn(TIME_BLOCK, F.explode(_times(stamp, step, width)))
    inner = F.col(STATION_BLOCK) == own_block
    kept = {"period", "StationId", "TimeStamp", STATION_BLOCK, TIME_BLOCK, BLOCKS, *margin}
    rows = rows.withColumn(COPY, ~inner | (F.col(TIME_BLOCK) != own_time))
    rows = rows.select(*[F.col(f"`{c}`") if c in kept or c == COPY else F.when(inner, F.col(f"`{c}`")).alias(c) for c in rows.columns]).drop(BLOCKS)
    shared = stamps.withColumn(STATION_BLOCK, F.explode(blocks)).withColumn(TIME_BLOCK, F.explode(_times(stamp, step, width)))
    both = rows.unionByName(shared.withColumn(COPY, F.lit(True)), allowMissingColumns=True)
    return both.repartition(*TILE)


def from_stamp(columns: list[str]) -> dict[str, Column]:
    """The columns of the stamp's own row, for every row of the stamp."""
    stamp = Window.partitionBy(*TILE, "TimeStamp").orderBy("StationId").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {c: F.first(f"`{c}`").over(stamp) for c in columns}


def inner_cells(rows: DataFrame) -> DataFrame:
    """Tiles without their margins, put together again."""
    return rows.where(~F.col(COPY)).drop(STATION_BLOCK, TIME_BLOCK, COPY)
