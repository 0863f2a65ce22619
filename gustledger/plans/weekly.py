"""Weekly report over stored results, and the whole way there from signals and alarms."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from gustledger.functions import timegrid as tg
from gustledger.operators import adjustments as J
from gustledger.operators import kpi as K
from gustledger.plans.monthly import Settings, calculate
from gustledger.plans.settle import settle
from gustledger.sources import schemas as S
from gustledger.sources import writers
from gustledger.sources.readers import read_results


def weekly(
    spark: SparkSession, path: str, periods: list[str], start, end, turbines: int = S.TURBINES, masts=S.MASTS,
    first_station: int = S.FIRST_STATION,
) -> tuple[DataFrame, DataFrame]:
    """Weekly indicators and the turbines that lost most, from the months the week touches."""
    results = read_results(spark, path, periods)
    return K.weekly_report(K.weekly_kpi(results, start, end, turbines, masts)), K.top_loss(results, start, end, first_station=first_station)


def months_of(spark: SparkSession, start, end) -> list[str]:
    """The months a range of days touches."""
    return spark.range(1).select(tg.periods_between(tg.as_ntz(start), tg.as_ntz(end)).alias("m")).first()["m"]


class Week(NamedTuple):
    """Outcome of :func:`process_week`."""

    report: DataFrame
    top: DataFrame
    #: Monthly table of the months touched, by station.
    grouped: DataFrame
    #: The correction list with the ends that production has closed.
    adjustments: DataFrame
    left_open: DataFrame


def process_week(
    spark: SparkSession,
    read: Callable[[list[str]], dict[str, DataFrame]],
    lookups: dict[str, DataFrame],
    path: str,
    start,
    end,
    now: str,
    adjustments: DataFrame,
    settings: Settings = Settings(),
    first_station: int = S.FIRST_STATION,
    masts=S.MASTS,
) -> Week:
    """From signals and alarms to the report of a week.

    ``read`` gives the input tables of a list of months, ``lookups`` the further arguments of
    ``monthly.calculate`` by name. The alarms are corrected from the list, the months are
    calculated and stored at ``path``, ends found by production enter the list, entries that are
    no longer needed leave it, and the report reads what was stored.
    """
    periods = months_of(spark, start, end)
    frames = read(periods)
    raw = frames["sum"]
    done = calculate({**frames, "sum": J.apply_adjustments(raw, adjustments)}, settings=settings, **lookups)
    # Results come out of tiles, evenly dealt over the tasks, and a week touches two months at most.
    writers.write_results(done.results, path, rebalance=False)
    kept = J.remove_adjustments(adjustments, J.stale_adjustments(raw, adjustments))
    listed = settle(J.upsert_adjustments(kept, done.imputed, now))
    report, top = weekly(spark, path, periods, start, end, settings.turbines, masts, first_station)
    return Week(report, top, K.grouped_results(read_results(spark, path, periods)), listed, done.left_open)
