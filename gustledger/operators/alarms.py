"""Alarm log operators: types, clamping, open ends, overlap resolution, spreading over the grid.

Alarm frames carry ``period`` (the month they are counted in) next to
``ID, TimeOn, TimeOff, StationNr, Alarmcode, Parameter``.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg
from gustledger.functions.nulls import is_true
from gustledger.operators.blocks import first_at_or_after, last_before, running_max_before
from gustledger.sources import schemas as S

STATION_KEYS = ["period", "StationNr"]
STOPPING = "_stopping"


# ---------------------------------------------------------------- code joins

def with_alarm_type(al: DataFrame, codes: DataFrame) -> DataFrame:
    """Alarms with a stopping code, with its type and text.

    The code list is small and Spark sees its size: it is broadcast below the
    session threshold, and otherwise a frequent code is split by adaptive skew handling.
    """
    stopping = codes.where(F.col("Error Type").isin(*S.STOPPING_TYPES))
    return al.join(stopping, "Alarmcode", "inner")


def with_alarm_text(al: DataFrame, codes: DataFrame) -> DataFrame:
    """All alarms; type and text stay NULL for unknown codes."""
    return al.join(codes, "Alarmcode", "left")


def stopping_alarms(al: DataFrame, codes: DataFrame) -> DataFrame:
    stopping = codes.where(F.col("Error Type").isin(*S.STOPPING_TYPES)).select("Alarmcode")
    return al.join(stopping, "Alarmcode", "left_semi")


def flag_stopping(al: DataFrame, codes: DataFrame) -> DataFrame:
    """Add a boolean telling whether the code is of a stopping type."""
    stopping = codes.where(F.col("Error Type").isin(*S.STOPPING_TYPES)).select("Alarmcode", F.lit(True).alias("_hit"))
    return al.join(stopping, "Alarmcode", "left").withColumn(STOPPING, F.col("_hit").isNotNull()).drop("_hit")


# ------------------------------------------------------------ source listing

def source_alarms(
    al: DataFrame, codes: DataFrame, station: int | None = None, code: int | None = None, kind: str | None = None
) -> DataFrame:
    """Raw alarms for display, unordered.  ``kind``: ``stopping`` or ``non_stopping`` (unknown codes count there)."""
    if station is not None:
        al = al.where(F.col("StationNr") == station)
    if code is not None:
        al = al.where(F.col("Alarmcode") == code)
    rows = with_alarm_text(al, codes)
    stops = is_true(F.col("Error Type").isin(*S.STOPPING_TYPES))
    if kind == "stopping":
        rows = rows.where(stops)
    elif kind == "non_stopping":
        rows = rows.where(~stops)
    return rows.select(
        F.col("ID").alias("id"),
        F.col("StationNr").alias("station_nr"),
        F.col("Alarmcode").alias("alarm_code"),
        tg.iso(F.col("TimeOn")).alias("time_on"),
        tg.iso(F.col("TimeOff")).alias("time_off"),
        F.coalesce("Parameter", F.lit("")).alias("parameter"),
        F.coalesce(F.col("Error Type").cast("string"), F.lit("Unknown")).alias("error_type"),
        F.coalesce("UK Text", F.lit("")).alias("description"),
    )


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("time_on"), F.desc("id"))


# ------------------------------------------------------------------ clamping

def open_stopping() -> Column:
    return F.col(STOPPING) & F.col("TimeOff").isNull()


def impute_end_from_production(al: DataFrame, production: DataFrame, step: timedelta = tg.TEN_MINUTES) -> DataFrame:
    """End open stopping alarms at the first producing interval that starts at or after their start.

    ``al`` carries the stopping flag; ``production`` has ``period, StationId, TimeStamp``
    of producing intervals.  Alarms without a later producing interval stay open.
    """
    asks = al.where(open_stopping())
    idle = al.where(~open_stopping())
    facts = production.select("period", F.col("StationId").cast("long").alias("StationNr"), "TimeStamp")
    found = first_at_or_after(
        asks, tg.plus(F.col("TimeOn"), step), facts, "TimeStamp", STATION_KEYS, "_produced"
    )
    ended = found.withColumn("TimeOff", F.col("_produced")).drop("_produced")
    return idle.unionByName(ended)


#: Fixed value: the note of a correction that closes an alarm by production.
IMPUTED_NOTE = "Auto-imputed from production data"


def imputed_adjustments(al: DataFrame, production: DataFrame, step: timedelta = tg.TEN_MINUTES) -> DataFrame:
    """Requests for ``upsert_adjustments``: one per open stopping alarm that production ends.

    Only the end and the note are set. Of an id that stands in the log more than once, the latest
    end counts. Alarms that stay open give no request; ``left_open`` lists them.
    """
    ended = impute_end_from_production(al.where(open_stopping()), production, step).where(F.col("TimeOff").isNotNull())
    latest = F.max_by(F.struct("Alarmcode", "StationNr", "TimeOff"), F.struct("TimeOff", "TimeOn", "Alarmcode", "StationNr"))
    one = ended.where(F.col("ID").isNotNull()).groupBy("ID").agg(latest.alias("a"))
    return one.select(
        F.col("ID").alias("pos"),
        F.col("ID").alias("id"),
        F.col("a.Alarmcode").cast("long").alias("alarm_code"),
        F.col("a.StationNr").cast("long").alias("station_nr"),
        F.lit(None).cast("string").alias("time_on"),
        F.substring(F.col("a.TimeOff").cast("string"), 1, 19).alias("time_off"),
        F.lit(IMPUTED_NOTE).alias("notes"),
        F.lit(False).alias("set_time_on"),
        F.lit(True).alias("set_time_off"),
        F.lit(True).alias("set_notes"),
    )


def left_open(al: DataFrame, production: DataFrame, step: timedelta = tg.TEN_MINUTES) -> DataFrame:
    """Open stopping alarms without later production, which last to the end of the month."""
    return impute_end_from_production(al.where(open_stopping()), production, step).where(F.col("TimeOff").isNull())


def open_stations(al: DataFrame) -> DataFrame:
    """Stations with an open stopping alarm, per month."""
    return al.where(open_stopping()).select("period", F.col("StationNr").alias("StationId")).distinct()


def clamp_alarms(al: DataFrame, bounds: DataFrame, step: timedelta = tg.TEN_MINUTES) -> DataFrame:
    """Limit alarms to their month.

    ``al`` carries the stopping flag; ``bounds`` has one row per calendar month (so it
    is always broadcast) with ``period, period_start, period_end``.  The order of the rules matters:
    open stopping alarms end with the month, ends are capped, stopping alarms over
    before the buffer go, alarms starting after the end go, stopping alarms start
    no earlier than the buffer, and other alarms from before it go.
    """
    stopping, on, off = F.col(STOPPING), F.col("TimeOn"), F.col("TimeOff")
    rows = (
        al.where(on.isNotNull())
        .join(F.broadcast(bounds), "period")
        .withColumn("_buffer", tg.plus(F.col("period_start"), -step))
        .withColumn("TimeOff", F.when(stopping, F.coalesce(off, F.col("period_end"))).otherwise(off))
        .withColumn("TimeOff", F.least(off, F.when(off.isNotNull(), F.col("period_end"))))
    )
    rows = rows.where(~(is_true((on < F.col("_buffer")) & (off < F.col("_buffer"))) & stopping))
    rows = rows.where(on <= F.col("period_end"))
    rows = rows.where(stopping | (on >= F.col("_buffer")))
    return rows.withColumn("TimeOn", F.when(stopping, F.greatest(on, F.col("_buffer"))).otherwise(on)).drop(
        "_buffer", "period_start", "period_end"
    )


def earliest_start(al: DataFrame, bounds: DataFrame, step: timedelta = tg.TEN_MINUTES) -> DataFrame:
    """First alarm start of a month among the alarms that reach into it (before starts are raised)."""
    on, off, stopping = F.col("TimeOn"), F.col("TimeOff"), F.col(STOPPING)
    buffer = tg.plus(F.col("period_start"), -step)
    end = F.when(stopping, F.coalesce(off, F.col("period_end"))).otherwise(off)
    return (
        al.join(F.broadcast(bounds), "period")
        .where(~(is_true((on < buffer) & (F.least(end, F.col("period_end")) < buffer)) & stopping & end.isNotNull()))
        .where(on <= F.col("period_end"))
        .groupBy("period")
        .agg(F.min("TimeOn").alias("warning_date"))
    )


def active_alarms(al: DataFrame, bounds: DataFrame, code: int = S.POWER_LIMIT_CODE, step: timedelta = tg.TEN_MINUTES) -> DataFrame:
    """Alarms of one code that start in, end in or span the month; open ones end with it."""
    on, off = F.col("TimeOn"), F.col("TimeOff")
    first, last = tg.plus(F.col("period_start"), -step), F.col("period_end")
    inside = ((first < on) & (on < last)) | ((first < off) & (off < last)) | ((on < first) & (last < off))
    return (
        al.where(F.col("Alarmcode") == code)
        .join(F.broadcast(bounds), "period")
        .where(inside)
        .withColumn("NewTimeOn", on)
        .withColumn("TimeOff", F.coalesce(off, last))
        .drop("period_start", "period_end")
    )


# ------------------------------------------------------- overlap resolution

def cascade(al: DataFrame, width: timedelta = tg.ONE_HOUR) -> DataFrame:
    """Give every alarm only the time no earlier alarm of its station already covers.

    With ``M`` the latest end of earlier alarms (own start for the first): an alarm
    ending by ``M`` keeps nothing, one starting at or after ``M`` keeps all, any
    other starts at ``M``.
    """
    on, off, reach = F.col("TimeOn"), F.col("TimeOff"), F.coalesce(F.col("_reach"), F.col("TimeOn"))
    new_on = F.when(off <= reach, off).when(on >= reach, on).when(off > reach, reach)
    seconds = F.abs(tg.seconds_between(F.col("NewTimeOn"), off))
    return (
        running_max_before(al, STATION_KEYS, ["TimeOn", "ID"], "TimeOff", "_reach", width)
        .withColumn("NewTimeOn", new_on)
        .withColumn("EffectiveAlarmTime", seconds)
        .withColumn("Period 0(s)", F.when(F.col("Error Type") == 0, F.col("EffectiveAlarmTime")))
        .withColumn("Period 1(s)", F.when(F.col("Error Type") == 1, F.col("EffectiveAlarmTime")))
        .drop("_reach")
    )


def previous_reach(al: DataFrame, width: timedelta = tg.ONE_HOUR) -> DataFrame:
    """Add ``TimeOffMax``: the latest end of earlier alarms of the station, own start for the first."""
    rows = running_max_before(al, STATION_KEYS, ["TimeOn", "ID"], "TimeOff", "TimeOffMax", width)
    return rows.withColumn("TimeOffMax", F.coalesce("TimeOffMax", "TimeOn"))


def drop_zero_alarms(al: DataFrame, keep_code: int = S.MAINTENANCE_CODE) -> DataFrame:
    """Drop alarms without effective time, except one code."""
    return al.where(~is_true((F.col("EffectiveAlarmTime") <= 0) & (F.col("Alarmcode") != keep_code)))


def free_time(rows: DataFrame, scanned: DataFrame, code: int) -> DataFrame:
    """Per station the stretches no alarm of ``code`` covers, as ``_from, _to`` (NULL: open)."""
    other, own = F.col("Alarmcode") != code, F.col("Alarmcode") == code
    span = rows.groupBy(*STATION_KEYS).agg(
        F.min(F.when(other, F.col("TimeOn"))).alias("_lo"),
        F.min(F.when(own, F.col("TimeOn"))).alias("_first"),
        F.max(F.when(own, F.col("TimeOff"))).alias("_covered"),
    )
    head = span.select(*STATION_KEYS, F.col("_lo").alias("_from"), F.col("_first").alias("_to"))
    tail = span.select(*STATION_KEYS, F.col("_covered").alias("_from"), F.lit(None).cast("timestamp_ntz").alias("_to"))
    between = scanned.where(own).select(*STATION_KEYS, F.col("_reach").alias("_from"), F.col("TimeOn").alias("_to"))
    stretches = head.unionByName(between).unionByName(tail)
    return stretches.where(F.col("_from").isNotNull() & (F.col("_to").isNull() | (F.col("_from") < F.col("_to"))))


def subtract_alarms(al: DataFrame, code: int = S.MAINTENANCE_CODE, width: timedelta = tg.ONE_HOUR) -> DataFrame:
    """Cut the time of ``code`` out of all other alarms of the station: keep, trim, split or remove.

    ``al`` is the result of :func:`cascade`, so the other alarms of a station do not
    overlap; ``OldTimeOn`` holds the raw start.  A remaining segment is what an alarm
    shares with a stretch the code leaves free.  It starts either with the alarm,
    inside the last stretch begun, or with a stretch, inside the last alarm begun: one
    scan over both kinds finds every segment once and never pairs rows up.  A segment
    is identified by ``ID`` and ``TimeOn``; :func:`cascade` follows.
    """
    own, backward = F.col("Alarmcode") == code, F.col("TimeOff") < F.col("TimeOn")
    rows = (
        drop_zero_alarms(al, code)
        .withColumn("TimeOn", F.when(own, F.col("OldTimeOn")).otherwise(F.col("NewTimeOn")))
        .drop("NewTimeOn", "EffectiveAlarmTime", "Period 0(s)", "Period 1(s)")
    )
    columns = rows.columns
    # The code's own alarms in time order with the reach of the earlier ones.  An alarm that ends
    # before it starts is asked at its end: it goes when one alarm of the code covers it.
    odd = ~own & backward
    asked = rows.where(own | odd).withColumns(
        {"_at": F.when(own, F.col("TimeOn")).otherwise(F.col("TimeOff")), "_end": F.when(own, F.col("TimeOff")), "_own": own}
    )
    scanned = running_max_before(asked, STATION_KEYS, ["_at", "_own", "_end", "ID"], "_end", "_reach", width)
    kept = scanned.where(own | F.col("_reach").isNull() | (F.col("_reach") <= F.col("TimeOn"))).select(*columns)

    alarm, stretch = F.struct(*columns), F.struct("_from", "_to")
    begun = (
        rows.where(~own & ~backward)
        .select(*STATION_KEYS, F.col("TimeOn").alias("_at"), F.lit(1).alias("_kind"), alarm.alias("_alarm"))
        .unionByName(
            free_time(rows, scanned, code).select(
                *STATION_KEYS, F.col("_from").alias("_at"), F.lit(0).alias("_kind"), stretch.alias("_stretch")
            ),
            allowMissingColumns=True,
        )
    )
    met = last_before(
        begun, STATION_KEYS, ["_at", "_kind"], {"_last_alarm": F.col("_alarm"), "_last_stretch": F.col("_stretch")}, width
    ).select(
        "_at",
        F.coalesce("_alarm", "_last_alarm").alias("_alarm"),
        F.coalesce("_stretch", "_last_stretch").alias("_stretch"),
    )
    end = F.least(F.col("_alarm.TimeOff"), F.col("_stretch._to"))
    moved = {"TimeOn": F.col("_at"), "TimeOff": end}
    both = F.col("_alarm").isNotNull() & F.col("_stretch").isNotNull()
    segments = met.where(both & (F.col("_at") < end)).select(
        *[moved.get(c, F.col(f"_alarm.`{c}`")).alias(c) for c in columns]
    )
    return segments.unionByName(kept)


# ------------------------------------------------------------ grid intervals

def to_intervals(al: DataFrame, step: timedelta = tg.TEN_MINUTES, split_types: bool = True) -> DataFrame:
    """One row per alarm and grid stamp it reaches, with the seconds inside that interval.

    An alarm starting exactly on a stamp also gets that stamp, with zero seconds.
    """
    on, off = F.col("NewTimeOn"), F.col("TimeOff")
    rows = al.withColumn("TimeStamp", F.explode(tg.stamps(tg.ceil_to(on, step), tg.ceil_to(off, step), step)))
    seconds = tg.overlap_seconds(F.col("TimeStamp"), on, off, step)
    return _typed_seconds(rows, seconds) if split_types else rows.withColumn("EffectiveAlarmTime", seconds)


def alarm_by_interval(intervals: DataFrame) -> DataFrame:
    """Stopped seconds, by type, and the texts of the alarms per station and stamp.

    The texts of one cell are few: after the cascade the alarms of a station do not
    overlap, so a cell holds no more than fit in one step one after the other.
    """
    return _by_interval(intervals)


def _by_interval(intervals: DataFrame, *more: Column) -> DataFrame:
    return intervals.groupBy(*STATION_KEYS, "TimeStamp").agg(
        F.sum("EffectiveAlarmTime").alias("EffectiveAlarmTime"),
        F.sum("Period 0(s)").alias("Period 0(s)"),
        F.sum("Period 1(s)").alias("Period 1(s)"),
        F.expr("listagg(`UK Text`, '|') WITHIN GROUP (ORDER BY TimeOn, ID)").alias("UK Text"),
        *more,
    )


def stopped_by_interval(al: DataFrame, step: timedelta = tg.TEN_MINUTES) -> DataFrame:
    """``alarm_by_interval(to_intervals(al))`` for alarms of a station that do not overlap, as after :func:`cascade`.

    Such an alarm shares at most its first and its last interval with others. Only these two are
    aggregated; the full intervals between them are one run per alarm, laid out after the
    shuffle. So what is shuffled follows the number of alarms and not their length. Alarms without
    time of their own lie inside others after the cascade and must be left out before.
    """
    on, off, whole = F.col("NewTimeOn"), F.col("TimeOff"), float(step.total_seconds())
    first, last = tg.ceil_to(on, step), tg.ceil_to(off, step)
    # The edges: one interval for an alarm inside one, else two. The run goes with the first of them.
    stamp = F.explode(F.when(first < last, F.array(first, last)).when(first == last, F.array(first)).otherwise(F.array().cast("array<timestamp_ntz>")))
    run = F.struct(tg.plus(first, step).alias("start"), tg.plus(last, -step).alias("end"), "Error Type", "UK Text")
    edges = _typed_seconds(al.withColumn("TimeStamp", stamp), tg.overlap_seconds(F.col("TimeStamp"), on, off, step))
    edges = edges.withColumn("_run", F.when((F.col("TimeStamp") == first) & (first < tg.plus(last, -step)), run))
    cells = _by_interval(edges, F.collect_list("_run").alias("_runs"))

    def laid_out(r: Column) -> Column:
        kinds = [F.when(r["Error Type"] == k, whole).otherwise(0.0).alias(f"Period {k}(s)") for k in S.STOPPING_TYPES]
        return F.transform(tg.stamps(r["start"], r["end"], step), lambda t: F.struct(t.alias("TimeStamp"), F.lit(whole).alias("EffectiveAlarmTime"), *kinds, r["UK Text"].alias("UK Text")))

    values = ["TimeStamp", "EffectiveAlarmTime", *[f"Period {k}(s)" for k in S.STOPPING_TYPES], "UK Text"]
    own = F.array(F.struct(*[F.col(f"`{c}`") for c in values]))
    return cells.select(*STATION_KEYS, F.inline(F.concat(own, F.flatten(F.transform("_runs", laid_out)))))


def _typed_seconds(rows: DataFrame, seconds: Column) -> DataFrame:
    rows = rows.withColumn("EffectiveAlarmTime", seconds)
    split = {f"Period {k}(s)": F.when(F.col("Error Type") == k, F.col("EffectiveAlarmTime")).otherwise(0.0) for k in S.STOPPING_TYPES}
    return rows.withColumns(split)


def warning_duration(intervals: DataFrame, per_station: bool = True) -> DataFrame:
    """Seconds under the power-limit warning per stamp.

    ``per_station=False`` sums a stamp over all stations and puts it on the station
    whose warning started first.
    """
    total = F.sum("EffectiveAlarmTime").alias("Duration 2006(s)")
    if per_station:
        return intervals.groupBy("period", "TimeStamp", F.col("StationNr").alias("StationId")).agg(total)
    first = F.min(F.struct("TimeOn", "StationNr", "ID"))
    return (
        intervals.groupBy("period", "TimeStamp")
        .agg(total, first.alias("_first"))
        .select("period", "TimeStamp", F.col("_first.StationNr").alias("StationId"), "Duration 2006(s)")
    )
