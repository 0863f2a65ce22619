"""Manual corrections of alarm times, and edits of the correction list.

A correction list is a DataFrame ``pos, id, alarm_code, station_nr, time_on,
time_off, notes, last_updated``; ids may repeat and ``pos`` is the list order.
Times are text and empty text counts as not given.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg
from gustledger.functions.nulls import is_true

AUTOMATIC = "Auto-imputed"
TEXT_FIELDS = ("time_on", "time_off", "notes", "last_updated")


def given(column: str) -> Column:
    return is_true(F.col(column) != "")


def when_parsed(column: str) -> Column:
    return F.when(given(column), tg.parse_time(F.col(column)))


def strict_time(column: str) -> Column:
    return tg.parse_whole_seconds(F.col(column))


# ----------------------------------------------------------------- overlay

def ranked(adj: DataFrame) -> DataFrame:
    """Parsed entries with the place of the first valid end of their id."""
    rows = adj.select(
        "id",
        "pos",
        when_parsed("time_on").alias("_on"),
        when_parsed("time_off").alias("_off"),
        (is_true(F.contains(F.col("notes"), F.lit(AUTOMATIC))) & F.col("time_off").isNotNull()).alias("_auto"),
    )
    first = rows.groupBy("id").agg(F.min(F.when(F.col("_off").isNotNull(), F.col("pos"))).alias("_first_end"))
    return rows.join(first, "id")


def fold(rows: DataFrame) -> DataFrame:
    """One row per id: the last valid times, once for closed and once for open alarms.

    An automatic entry with an end is skipped when the alarm already has one: in a
    closed alarm always, in an open one after the first valid end of the list.
    """
    late = F.col("_auto") & is_true(F.col("pos") > F.col("_first_end"))

    def last(column: str, skip: Column) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull() & ~skip, F.col("pos")))

    return rows.groupBy("id").agg(
        last("_on", F.col("_auto")).alias("closed_on"),
        last("_off", F.col("_auto")).alias("closed_off"),
        last("_on", late).alias("open_on"),
        last("_off", late).alias("open_off"),
    )


def apply_adjustments(al: DataFrame, adj: DataFrame) -> DataFrame:
    """Alarms with their corrected times; ``al`` is the raw extract."""
    times = fold(ranked(adj)).withColumnRenamed("id", "ID")
    closed = F.col("TimeOff").isNotNull()
    on = F.coalesce(F.when(closed, F.col("closed_on")).otherwise(F.col("open_on")), F.col("TimeOn"))
    off = F.coalesce(F.when(closed, F.col("closed_off")).otherwise(F.col("open_off")), F.col("TimeOff"))
    return (
        al.join(times, "ID", "left")
        .withColumn("_on", on)
        .withColumn("TimeOff", off)
        .withColumn("TimeOn", F.col("_on"))
        .select(*al.columns)
    )


def stale_adjustments(al: DataFrame, adj: DataFrame) -> DataFrame:
    """Ids with an automatic end that is no longer needed, to be removed from the list."""
    automatic = ranked(adj).where(F.col("_auto")).withColumnRenamed("id", "ID")
    needless = F.col("TimeOff").isNotNull() | is_true(F.col("pos") > F.col("_first_end"))
    return (
        automatic.join(al.select("ID", "TimeOff"), "ID")
        .where(needless)
        .select(F.col("ID").alias("id"))
        .distinct()
    )


# ------------------------------------------------------------------- edits

def next_pos(adj: DataFrame) -> Column:
    return adj.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).scalar()


def upsert_adjustments(adj: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Update or insert by id.

    ``changes`` has ``pos, id, alarm_code, station_nr, time_on, time_off, notes`` and
    ``set_time_on, set_time_off, set_notes``: a field that is not set keeps its value,
    a set NULL overwrites.  Repeated ids apply in order; the last list entry of an id
    is the one updated; inserts take code and station of their first request.
    """
    return merge_changes(adj, changes.withColumn("last_updated", F.lit(now)))


def merge_changes(adj: DataFrame, changes: DataFrame) -> DataFrame:
    """:func:`upsert_adjustments` with requests that carry their own ``last_updated``; the latest request's counts."""
    fields = ("time_on", "time_off", "notes")

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(f"set_{c}"), F.col("pos"))).alias(f"_{c}")

    def touched(c: str) -> Column:
        return F.max(F.col(f"set_{c}")).alias(f"_set_{c}")

    requests = (
        changes.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(
            *[latest(c) for c in fields],
            *[touched(c) for c in fields],
            F.min("pos").alias("_pos"),
            F.max_by("last_updated", "pos").alias("_now"),
            F.min_by(F.struct("alarm_code", "station_nr"), "pos").alias("_new"),
        )
    )
    last = adj.groupBy("id").agg(F.max("pos").alias("_last"))
    target = requests.join(last, "id", "left")
    # Every list entry meets at most one request: updates go to the last entry of an id.
    hits = target.where(F.col("_last").isNotNull()).withColumnRenamed("_last", "pos")
    updated = adj.join(hits, ["id", "pos"], "left").select(
        "pos",
        "id",
        "alarm_code",
        "station_nr",
        *[F.when(F.col(f"_set_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(F.col("_pos").isNotNull(), F.col("_now")).otherwise(F.col("last_updated")).alias("last_updated"),
    )
    inserted = target.where(F.col("_last").isNull()).select(
        (F.col("_pos") + next_pos(adj)).alias("pos"),
        "id",
        F.coalesce(F.col("_new.alarm_code"), F.lit(0)).alias("alarm_code"),
        F.coalesce(F.col("_new.station_nr"), F.lit(0)).alias("station_nr"),
        F.when(F.col("_set_time_on"), F.col("_time_on")).alias("time_on"),
        F.when(F.col("_set_time_off"), F.col("_time_off")).alias("time_off"),
        F.when(F.col("_set_notes"), F.col("_notes")).otherwise(F.lit("")).alias("notes"),
        F.col("_now").alias("last_updated"),
    )
    return updated.unionByName(inserted)


def update_adjustments(adj: DataFrame, ids: DataFrame, now: str, **fields) -> DataFrame:
    """Set the same fields on every entry of the given ids."""
    chosen = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    rows = adj.join(chosen, "id", "left")
    hit = F.col("_hit").isNotNull()
    for name, value in {**fields, "last_updated": now}.items():
        rows = rows.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    return rows.select(*adj.columns)


def remove_adjustments(adj: DataFrame, ids: DataFrame) -> DataFrame:
    return adj.join(ids.select("id"), "id", "left_anti").select(*adj.columns)


def add_adjustments(adj: DataFrame, new: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Append entries with new ids and valid times; returns the new list and the refused entries.

    An entry needs a start or an end, in the fixed text form, and an end after its
    start.  Of several valid entries with one id the first counts.
    """
    on, off = strict_time("time_on"), strict_time("time_off")
    reason = (
        F.when(~given("time_on") & ~given("time_off"), "no time given")
        .when(given("time_on") & on.isNull(), "bad time_on")
        .when(given("time_off") & off.isNull(), "bad time_off")
        .when(is_true(given("time_on") & given("time_off") & (off <= on)), "end not after start")
    )
    checked = new.withColumn("reason", reason)
    first = checked.where(F.col("reason").isNull()).groupBy("id").agg(F.min("pos").alias("_first"))
    known = adj.select("id").distinct().withColumn("_known", F.lit(True))
    rows = checked.join(first, "id", "left").join(known, "id", "left")
    rows = rows.withColumn(
        "reason",
        F.when(F.col("_known"), "id exists")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("pos") > F.col("_first"), "id exists"),
    )
    fresh = rows.where(F.col("reason").isNull()).select(
        (F.col("pos") + next_pos(adj)).alias("pos"),
        "id",
        "alarm_code",
        "station_nr",
        F.when(given("time_on"), F.col("time_on")).alias("time_on"),
        F.when(given("time_off"), F.col("time_off")).alias("time_off"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.lit(now).alias("last_updated"),
    )
    return adj.unionByName(fresh), rows.where(F.col("reason").isNotNull()).select(*new.columns, "reason")


def edit_adjustments(adj: DataFrame, edits: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Change the first entry of an id; returns the new list and the refused edits.

    ``edits`` has at most one row per id with ``id, time_on, time_off, notes``.  A new
    start must lie before the end already stored, a new end after the resulting start.
    """
    asked = edits.select("id", *[F.col(c).alias(f"_{c}") for c in ("time_on", "time_off", "notes")])
    first = adj.groupBy("id").agg(F.min("pos").alias("_target"))
    # Entries without an id have no target; they stay as they are.
    paired = adj.join(first, "id", "left").join(asked.withColumn("_asked", F.lit(True)), "id", "left")
    hit = F.col("_asked").isNotNull() & (F.col("pos") == F.col("_target"))

    new_on, new_off = strict_time("_time_on"), strict_time("_time_off")
    result_on = F.when(given("_time_on"), new_on).otherwise(strict_time("time_on"))
    reason = (
        F.when(given("_time_on") & new_on.isNull(), "bad time_on")
        .when(is_true(given("_time_on") & (new_on >= strict_time("time_off"))), "start not before end")
        .when(given("_time_off") & new_off.isNull(), "bad time_off")
        .when(is_true(given("_time_off") & (new_off <= result_on)), "end not after start")
    )
    rows = paired.withColumn("reason", F.when(hit, reason))
    good = hit & F.col("reason").isNull()
    accepted = rows.select(
        "pos",
        "id",
        "alarm_code",
        "station_nr",
        *[
            F.when(good & given(f"_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            for c in ("time_on", "time_off")
        ],
        F.when(good & F.col("_notes").isNotNull(), F.col("_notes")).otherwise(F.col("notes")).alias("notes"),
        F.when(good, F.lit(now)).otherwise(F.col("last_updated")).alias("last_updated"),
    )
    refused = rows.where(hit & F.col("reason").isNotNull()).select("id", "reason")
    unknown = edits.join(adj.select("id"), "id", "left_anti").select("id", F.lit("id not found").alias("reason"))
    return accepted, refused.unionByName(unknown)


# ----------------------------------------------------------------- listing

def filter_adjustments(adj: DataFrame, code: int | None = None, station: int | None = None) -> DataFrame:
    conditions = []
    if code is not None:
        conditions.append(F.col("alarm_code") == code)
    if station is not None:
        conditions.append(F.col("station_nr") == station)
    return adj.where(reduce(Column.__and__, conditions)) if conditions else adj


def adjustment_ids(adj: DataFrame, code: int | None = None, station: int | None = None) -> DataFrame:
    return filter_adjustments(adj, code, station).where(F.col("id").isNotNull()).select("id")


def sort_key(sort_by: str | None) -> Column:
    """What the list is sorted by: a column with its missing values first, the id by default."""
    name = sort_by or "id"
    return F.coalesce(F.col(name), F.lit("") if name in TEXT_FIELDS else F.lit(0))


def adjustment_page_after(
    adj: DataFrame,
    last: Mapping | None = None,
    code: int | None = None,
    station: int | None = None,
    sort_by: str | None = None,
    desc: bool = False,
    size: int = 10,
) -> DataFrame:
    """The entries that follow the entry ``last`` in the order of :func:`adjustment_page`; the first ones without it.

    ``last`` is the last row of the page before, of which ``pos`` and the sorted column count. Every page
    keeps ``size`` rows per task, however far it is from the start, and entries that others
    add or remove in between shift nothing.
    """
    rows, key = filter_adjustments(adj, code, station), sort_key(sort_by)
    downwards = desc or sort_by is None
    if last is not None:
        seen = last[sort_by or "id"]
        seen = F.lit(seen if seen is not None else "" if sort_by in TEXT_FIELDS else 0)
        beyond = key < seen if downwards else key > seen
        rows = rows.where(beyond | ((key == seen) & (F.col("pos") > last["pos"])))
    return rows.orderBy(key.desc() if downwards else key.asc(), F.asc("pos")).limit(size)


def adjustment_page(
    adj: DataFrame,
    code: int | None = None,
    station: int | None = None,
    sort_by: str | None = None,
    desc: bool = False,
    page: int = 1,
    size: int = 10,
) -> DataFrame:
    """One page of the list with the total number of entries and pages; newest id first by default."""
    rows = filter_adjustments(adj, code, station)
    total = rows.agg(F.count(F.lit(1))).scalar()
    key = sort_key(sort_by).desc() if desc or sort_by is None else sort_key(sort_by).asc()
    pages = F.call_function("div", total + (size - 1), F.lit(size)) if size > 0 else F.lit(1)
    return (
        rows.orderBy(key, F.asc("pos"))
        .offset((page - 1) * size)
        .limit(size)
        .withColumn("total", total)
        .withColumn("total_pages", pages.cast("long"))
    )
