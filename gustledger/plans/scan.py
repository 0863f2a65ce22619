"""Data-quality scan of mast signals over any number of months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg
from gustledger.operators import quality as Q
from gustledger.plans.settle import settle
from gustledger.sources import schemas as S
from gustledger.sources.readers import periods_within
from gustledger.sources.writers import write_report


def scan_ranges(met: DataFrame, now, first_day=None, last_day=None) -> DataFrame:
    """The part of every month in ``met``, which may be a manifest of months, to scan; those outside the wanted days drop out."""
    start, end = tg.scan_range(F.col("period"), now, first_day, last_day)
    ranges = met.select("period").distinct().select("period", start.alias("range_start"), end.alias("range_end"))
    return ranges.where(F.col("range_start") <= F.col("range_end"))


def validation_scan(
    met: DataFrame,
    now,
    periods: list[str] | None = None,
    first_day: str | None = None,
    last_day: str | None = None,
    n: int | None = None,
    exclude_zero: bool = False,
    bounds=S.MET_BOUNDS,
    step=tg.TEN_MINUTES,
    manifest: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Issues and their summary for the chosen months and days.

    With a ``manifest`` of the stored months (``state.month_manifest``) no row is read to learn them.
    """
    months = periods_within(met, periods, first_day, last_day)
    known = months if manifest is None else periods_within(manifest, periods, first_day, last_day)
    ranges = scan_ranges(known, now, first_day, last_day)
    issues = Q.scan_met(months, ranges, bounds, n, exclude_zero, step)
    return issues, Q.issue_summary(issues, ranges)


def scan_report(met: DataFrame, now, path: str, **choice) -> tuple[DataFrame, DataFrame]:
    """Scan once, and write the issues and their summary, which is made from the issues found."""
    issues, _ = validation_scan(met, now, **choice)
    issues = settle(issues)
    known = met if choice.get("manifest") is None else choice["manifest"]
    days = [choice.get("first_day"), choice.get("last_day")]
    summary = Q.issue_summary(issues, scan_ranges(periods_within(known, choice.get("periods"), *days), now, *days))
    write_report(issues, summary, path)
    return issues, summary
