"""Arithmetic on a fixed-step time grid, on zone-free timestamps.

All steps are ``datetime.timedelta`` values.  A stamp labels the *end* of its
interval, so stamp ``t`` covers ``(t - step, t]``.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

TEN_MINUTES = timedelta(minutes=10)
ONE_HOUR = timedelta(hours=1)


def to_micros(step: timedelta) -> int:
    return step // timedelta(microseconds=1)


def ntz(value: datetime | str) -> Column:
    """A zone-free timestamp literal."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def as_ntz(value) -> Column:
    return value if isinstance(value, Column) else ntz(value)


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), ts)


def plus(ts: Column, step: timedelta) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(to_micros(step)), ts)


def ceil_to(ts: Column, step: timedelta) -> Column:
    """The first grid stamp at or after ``ts``."""
    return F.timestamp_add("MICROSECOND", F.pmod(-epoch_micros(ts), F.lit(to_micros(step))), ts)


def slot(ts: Column, width: timedelta) -> Column:
    """Number of the ``width``-long slot that holds ``ts`` (grows with time)."""
    return F.call_function(
        "div", epoch_micros(ts) - F.pmod(epoch_micros(ts), F.lit(to_micros(width))), F.lit(to_micros(width))
    )


def stamps(start: Column, end: Column, step: timedelta) -> Column:
    """Array of stamps from ``start`` to ``end`` inclusive; empty when start is after end."""
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(to_micros(step) / 1e6).cast("decimal(18,6)"))
    return F.when(start <= end, F.sequence(start, end, interval)).otherwise(
        F.array().cast("array<timestamp_ntz>")
    )


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def overlap_seconds(stamp: Column, on: Column, off: Column, step: timedelta) -> Column:
    """Seconds of ``[on, off]`` that fall in the interval ending at ``stamp``."""
    return seconds_between(F.greatest(plus(stamp, -step), on), F.least(stamp, off))


def parse_time(text: Column) -> Column:
    """Text with or without fractional seconds; anything else gives NULL.

    Parsed without a time zone, so local times in a clock change stay as written.
    """
    shape = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
    return F.when(text.rlike(shape), text.try_cast("timestamp_ntz"))


def parse_whole_seconds(text: Column) -> Column:
    """As :func:`parse_time`, but fractional seconds also give NULL."""
    return F.when(F.length(text) == 19, parse_time(text))


def iso(ts: Column) -> Column:
    text = ts.cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8))


def period_of(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 7)


def midnight(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def period_start(period: Column) -> Column:
    """First instant of a ``YYYY-MM`` month."""
    return F.to_date(F.concat(period, F.lit("-01"))).cast("timestamp_ntz")


def next_period_start(period: Column) -> Column:
    return F.add_months(F.to_date(F.concat(period, F.lit("-01"))), 1).cast("timestamp_ntz")


def month_end(period: Column) -> Column:
    """Last whole second of the month."""
    return plus(next_period_start(period), timedelta(seconds=-1))


def scan_range(period: Column, now, first_day=None, last_day=None) -> tuple[Column, Column]:
    """Start and end of the part of a month to scan.

    The month is cut at ``now``, at the start of ``first_day`` and at the last
    second of ``last_day``.  A range whose start is after its end is empty.
    """
    start, end = period_start(period), F.least(month_end(period), as_ntz(now))
    if first_day is not None:
        start = F.greatest(start, as_ntz(first_day))
    if last_day is not None:
        end = F.least(end, plus(midnight(as_ntz(last_day)), timedelta(days=1, seconds=-1)))
    return start, end


def week_window(target: Column) -> tuple[Column, Column]:
    """Seven days ending on the target day: first midnight and last 10-minute stamp."""
    day = midnight(target)
    return plus(day, timedelta(days=-6)), plus(day, timedelta(hours=23, minutes=50))


def days_in_range(start: Column, end: Column) -> Column:
    """Calendar days touched when counting from the start in whole days, both ends included."""
    return F.floor(seconds_between(start, end) / F.lit(86400.0)).cast("long") + 1


def periods_between(start: Column, end: Column) -> Column:
    """Array of the ``YYYY-MM`` months from the month of ``start`` to that of ``end``."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    return F.transform(months, lambda d: F.substring(d.cast("string"), 1, 7))
