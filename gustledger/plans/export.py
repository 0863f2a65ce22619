"""Export of one table: correct, reconcile with the stored copy, clean, and publish with its state."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustledger.operators import adjustments as J
from gustledger.operators import quality as Q
from gustledger.operators.reconcile import reconcile
from gustledger.plans.settle import settle
from gustledger.sources import writers
from gustledger.sources.state import changed_periods, latest_state, state_checksum

ALARM_KEYS, SIGNAL_KEYS = ["ID"], ["TimeStamp", "StationId"]


def export_rows(
    kind: str,
    source: DataFrame | None,
    existing: DataFrame | None,
    adjustments: DataFrame | None = None,
    mode: str = "append",
) -> DataFrame:
    """The rows to store.

    ``append``: source and stored copy reconciled; ``force-overwrite``: the source;
    ``process-existing``: the stored copy, corrected and cleaned again;
    ``process-existing-except-alarms``: that, but alarms as in ``append``.
    """
    if mode == "process-existing-except-alarms":
        mode = "append" if kind == "sum" else "process-existing"
    if mode == "process-existing":
        rows = existing if kind != "sum" or adjustments is None else J.apply_adjustments(existing, adjustments)
    else:
        rows = source if kind != "sum" or adjustments is None else J.apply_adjustments(source, adjustments)
        if mode == "append" and existing is not None:
            keys = ALARM_KEYS if kind == "sum" else SIGNAL_KEYS
            if "period" in rows.columns and "period" in existing.columns:
                keys = ["period", *keys]
            rows = reconcile(rows, existing, keys).drop("_change")
    return Q.nullify_met(rows) if kind == "met" else rows


def check_state(source: DataFrame, stored_state: DataFrame, columns: list[str], by=("period",)) -> DataFrame:
    """``check`` mode: per month whether the source differs from the state written with the stored copy."""
    return changed_periods(state_checksum(source, columns, by), stored_state, list(by))


class Export(NamedTuple):
    """What an incremental export writes: all are lazy."""

    #: The new content of the months that changed; write with ``writers.write_partitioned``.
    rows: DataFrame
    #: State of those months, to append to the metadata.
    state: DataFrame
    #: Ids of corrections to take off the list; None without a list.
    stale: DataFrame | None
    #: Completeness of those months by station; None for alarms and without ranges.
    completeness: DataFrame | None


def incremental_export(
    kind: str,
    source: DataFrame,
    existing: DataFrame,
    metadata: DataFrame,
    columns: list[str],
    written_at: str,
    adjustments: DataFrame | None = None,
    ranges: DataFrame | None = None,
) -> Export:
    """``append`` over any number of months: those whose count and checksum are as last written are left alone.

    ``metadata`` is the appended log of states of this table: ``period, row_count, checksum, last_updated``.
    """
    state = state_checksum(source, columns, ["period"])
    return _export(kind, source, existing, metadata, state, written_at, adjustments, ranges)


def _export(kind, source, existing, metadata, state, written_at, adjustments, ranges) -> Export:
    status = changed_periods(state, latest_state(metadata, ["period"]), ["period"])
    months = status.where("status <> 'NO_CHANGE'").select("period")
    fresh = source.join(months, "period", "left_semi")
    rows = export_rows(kind, fresh, existing.join(months, "period", "left_semi"), adjustments)
    written = state.join(months, "period", "left_semi").withColumn("last_updated", F.lit(written_at))
    stale = J.stale_adjustments(fresh, adjustments) if kind == "sum" and adjustments is not None else None
    complete = None
    if kind != "sum" and ranges is not None:
        wanted = ranges.join(months, "period", "left_semi")
        complete = Q.completeness(rows, wanted, by=("StationId",), end_inclusive=False)
    return Export(rows, written, stale, complete)


def publish_export(
    spark: SparkSession,
    kind: str,
    source: DataFrame,
    path: str,
    columns: list[str],
    written_at: str,
    adjustments: DataFrame | None = None,
    ranges: DataFrame | None = None,
) -> Export:
    """Run :func:`incremental_export` on the table stored at ``path`` and write what it gives.

    The state of the source is taken before its rows are read, months are staged beside the table
    and moved into place, and only then is the state appended to ``<path>_state``. A run that dies
    anywhere leaves months that the state does not claim, and the next run writes them again; a
    source that changes meanwhile is seen as changed next time. The result tells what was
    written: its ``rows`` are the stored months, ``state`` their new states.
    """
    log = f"{path.rstrip('/')}_state"
    writers.recover(spark, path)
    state = settle(state_checksum(source, columns, ["period"]))
    metadata = spark.read.parquet(log) if writers.exists(spark, log) else state.withColumn("last_updated", F.lit(written_at)).limit(0)
    existing = spark.read.parquet(path) if writers.exists(spark, path) else source.limit(0)
    done = _export(kind, source, existing, metadata, state, written_at, adjustments, ranges)
    written = settle(done.state)
    if not written.isEmpty():
        writers.publish(spark, writers.stage(done.rows, path), path)
        writers.append_state(written, log)
    stored = spark.read.parquet(path) if writers.exists(spark, path) else source.limit(0)
    complete = None
    if done.completeness is not None:
        wanted = ranges.join(written, "period", "left_semi")
        complete = Q.completeness(stored, wanted, by=("StationId",), end_inclusive=False)
    return Export(stored.join(written, "period", "left_semi"), written, done.stale, complete)
