"""The monthly availability calculation, for any number of months in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg
from gustledger.functions.nulls import or_zero
from gustledger.functions.numbers import round_numeric
from gustledger.operators import alarms as A
from gustledger.operators import energy as E
from gustledger.operators import grid as G
from gustledger.operators import losses as L
from gustledger.operators import tiles as T
from gustledger.plans.settle import settle
from gustledger.sources import schemas as S


@dataclass(frozen=True)
class Settings:
    """Numbers of the calculation; the defaults are the farm's."""

    step: timedelta = tg.TEN_MINUTES
    source: str = "energy"
    turbines: int = S.TURBINES
    availability_loss: float = 0.08
    efficiency: float = 0.92
    maintenance_code: int = S.MAINTENANCE_CODE
    power_limit_code: int = S.POWER_LIMIT_CODE
    warning_per_station: bool = True
    digits: int = 2


def alarm_segments(al: DataFrame, codes: DataFrame, maintenance_code: int = S.MAINTENANCE_CODE) -> DataFrame:
    """Non-overlapping effective alarm segments from clamped alarms."""
    typed = A.with_alarm_type(al, codes)
    # Each step reads its input in several branches, so it is written out in between.
    remaining = A.subtract_alarms(settle(A.cascade(typed)), maintenance_code)
    return A.cascade(settle(remaining))


def flagged_alarms(al: DataFrame, codes: DataFrame) -> DataFrame:
    """Raw alarms with the stopping flag, their raw times kept in ``OldTime*``."""
    return A.flag_stopping(al.withColumn("OldTimeOn", F.col("TimeOn")).withColumn("OldTimeOff", F.col("TimeOff")), codes)


def production_of_open(flagged: DataFrame, production: DataFrame) -> DataFrame:
    """The production of stations with an open alarm: only that needs to be sorted. Spark picks the join."""
    return production.join(A.open_stations(flagged), ["period", "StationId"], "left_semi")


def prepare_alarms(al: DataFrame, codes: DataFrame, bounds: DataFrame, production: DataFrame, step: timedelta) -> DataFrame:
    """Alarms with open ends closed and times limited to the month; raw times in ``OldTime*``."""
    flagged = flagged_alarms(al, codes)
    ended = A.impute_end_from_production(flagged, production_of_open(flagged, production), step)
    return A.clamp_alarms(ended, bounds, step)


#: What the losses of a station take from its neighbours, and the key of a tile's series.
MARGIN = ["wtc_AcWindSp_mean", "wtc_ActPower_min", "EffectiveAlarmTime"]
SERIES = (*T.TILE, "StationId")


def assess(cells: DataFrame, blocks: Column, curve: DataFrame, stat: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Potential energy and losses for the joined grid cells, which carry the ``_blocks`` of their station.

    The cells are read twice, for the averages of the stamps and for the losses, so they should be stored.
    """
    use = E.energy_to_use(settings.source)
    rows = T.tiled(cells, E.running_means(cells.withColumn("Energy_To_Use", use)), blocks, settings.step, MARGIN)
    rows = L.neighbour_values(rows.withColumns(T.from_stamp(["_mean", "_count"])), keys=(*T.TILE, "TimeStamp"))
    rows = rows.where(F.col("StationId").isNotNull()).withColumn("Energy_To_Use", use)
    rows = E.choose_potential(rows, curve, stat, settings.turbines, settings.availability_loss)
    rows = L.wind_patterns(L.split_losses(rows), keys=SERIES)
    return T.inner_cells(L.misassigned(rows))


def joined_cells(
    frames: dict[str, DataFrame], stopped: DataFrame, limited: DataFrame, stations: DataFrame, bounds: DataFrame, step: timedelta
) -> DataFrame:
    """The station x stamp grid with the signals of its stations, counter gaps filled.

    Each signal moves once, to its station's month, where the stamps are laid out, all signals are
    joined and the gaps are filled; the wide rows do not move.
    """
    cells = G.make_grid(stations, bounds, step, placed=True)
    wind = frames["tur"].select(*G.CELL, "wtc_AcWindSp_mean", "wtc_ActualWindDirection_mean")
    cells = G.join_signals(
        cells,
        [stopped.withColumnRenamed("StationNr", "StationId"), limited, frames["cnt"], frames["grd"], wind, frames["din"], frames["flg"]],
    )
    seconds = ("EffectiveAlarmTime", "Period 0(s)", "Period 1(s)", "Duration 2006(s)")
    return E.impute_energy(cells.withColumns({c: or_zero(F.col(f"`{c}`")) for c in seconds}), keys=(G.PLACE, *E.STATION_MONTH)).drop(G.PLACE)


class Calculation(NamedTuple):
    """What a calculation gives; all but the steps written out are lazy."""

    #: One row per station and stamp with energies, losses by cause and their durations.
    results: DataFrame
    #: Corrections for the ends that production has closed, for ``adjustments.upsert_adjustments``.
    imputed: DataFrame
    #: Open stopping alarms that no production ends.
    left_open: DataFrame
    #: Per month the first start among the alarms that reach into it.
    warning_date: DataFrame


def calculate(
    frames: dict[str, DataFrame],
    codes: DataFrame,
    curve: DataFrame,
    distribution: DataFrame,
    season: DataFrame,
    stations: DataFrame,
    settings: Settings = Settings(),
) -> Calculation:
    """The monthly calculation with what it finds out about open alarms."""
    step = settings.step
    sane = {k: E.sanity_filter(frames[k], k) if k in S.SANITY_BOUNDS else frames[k] for k in frames if k != "sum"}
    bounds = settle(G.period_end(frames["cnt"]))
    production = E.producing(sane["cnt"], sane["grd"], settings.source)
    alarms = settle(prepare_alarms(frames["sum"], codes, bounds, production, step))

    segments = alarm_segments(alarms.drop(A.STOPPING), codes, settings.maintenance_code)
    stopped = A.stopped_by_interval(segments.where(F.col("EffectiveAlarmTime") != 0), step)
    warnings = A.to_intervals(
        A.active_alarms(alarms, bounds, settings.power_limit_code, step), step, split_types=False
    )
    limited = A.warning_duration(warnings, settings.warning_per_station)

    placed = T.station_blocks(stations)
    cells = settle(joined_cells(sane, stopped, limited, placed, bounds, step))
    # The grid has no cell without a month. Where Spark knows that, results ordered by tiles are stored by month as they come.
    cells = cells.withColumn("period", F.coalesce("period", F.lit("")))
    blocks = F.sequence(F.lit(0), placed.agg(F.max(F.col(T.BLOCKS)[0])).scalar())
    stat = E.statistical_energy(curve, distribution, season, settings.efficiency)
    results = assess(cells, blocks, curve, stat, settings)
    if "met" in sane:
        # Masts join on the stamp alone, one row for all its stations: last, so that no shuffle of cells carries their values.
        results = G.join_signals(results, [], settle(sane["met"]))
    results = round_numeric(results, settings.digits)

    flagged = flagged_alarms(frames["sum"], codes)
    open_only = production_of_open(flagged, production)
    return Calculation(
        results,
        A.imputed_adjustments(flagged, open_only, step),
        A.left_open(flagged, open_only, step),
        A.earliest_start(flagged, bounds, step),
    )


def full_calculation(*inputs, **settings) -> DataFrame:
    """The results of :func:`calculate`, with its arguments."""
    return calculate(*inputs, **settings).results
