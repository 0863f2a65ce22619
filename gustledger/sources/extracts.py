"""Extracts from a source table (a Parquet or a JDBC relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg
from gustledger.functions.nulls import is_true
from gustledger.sources import schemas as S


def signal_extract(source: DataFrame, kind: str, start, end) -> DataFrame:
    """The columns of one kind with ``start <= TimeStamp < end``; both reach the scan."""
    ts = F.col("TimeStamp")
    columns = [c for c in S.SIGNAL_COLUMNS[kind] if c in source.columns]
    return source.where((ts >= tg.as_ntz(start)) & (ts < tg.as_ntz(end))).select("TimeStamp", "StationId", *columns)


def alarm_extract(source: DataFrame, stopping_codes: DataFrame, start, end, excluded: int = S.EXCLUDED_CODE) -> DataFrame:
    """Alarms that touch ``[start, end]``: ends in it, starts in it, spans it, or is open with a stopping code."""
    a, b = tg.as_ntz(start), tg.as_ntz(end)
    on, off = F.col("TimeOn"), F.col("TimeOff")
    log = source.where(F.col("Alarmcode") != excluded)
    touching = log.where(off.between(a, b) | on.between(a, b) | ((on <= a) & (off >= b)))
    # Open alarms are either inside by their start (above) or need a stopping code.
    still_open = log.where(off.isNull() & ~is_true(on.between(a, b))).join(
        stopping_codes.select("Alarmcode"), "Alarmcode", "left_semi"
    )
    columns = ["ID", *S.ALARM_COLUMNS]
    return touching.select(columns).unionByName(still_open.select(columns))
