"""Data quality of mast signals: completeness, empty rows, gaps, stuck and implausible values.

``met`` carries ``period, StationId, TimeStamp``; ``ranges`` has one row per month to
scan with ``period, range_start, range_end``.  All months are scanned in one job, and
every key contains the month.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustledger.functions import presence as P
from gustledger.functions import timegrid as tg
from gustledger.functions.nulls import is_true
from gustledger.sources import schemas as S

DEFAULT_RUN = 3
STATION_MONTH = ["period", "StationId"]

# Issue types in order of severity.
GLOBAL = "Global Connectivity"
SEVERITY = (
    ("completeness", 2.0),
    ("empty_row", 2.5),
    ("sensor_gap", 2.8),
    ("stuck_value", 3.0),
    ("out_of_range", 4.0),
)

ISSUE_SCHEMA = (
    "period string, type string, station_id string, sensor string, column string, count bigint, "
    "total_expected bigint, completeness_pct double, missing_timestamps array<string>, "
    "range_start timestamp_ntz, range_end timestamp_ntz, sample_value double, bound_low double, bound_high double"
)
ISSUE_FIELDS = tuple(part.strip().split(" ")[0] for part in ISSUE_SCHEMA.split(","))
ISSUE_TYPES = dict(part.strip().split(" ") for part in ISSUE_SCHEMA.split(","))


def as_issues(rows: DataFrame) -> DataFrame:
    """The common issue columns; those a type does not use are NULL."""
    have = set(rows.columns)
    return rows.select(
        *[
            (F.col(f"`{n}`") if n in have else F.lit(None)).cast(ISSUE_TYPES[n]).alias(n)
            for n in ISSUE_FIELDS
        ]
    )


def months(ranges: DataFrame) -> DataFrame:
    """The ranges, always sent to the rows: they have one row per calendar month.

    Without the hint Spark sees the size of the table the months were taken from, and
    would shuffle all rows by month.
    """
    return F.broadcast(ranges)


def with_range(met: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows inside the range of their month, with the range."""
    return met.join(months(ranges), "period").where(F.col("TimeStamp").between(F.col("range_start"), F.col("range_end")))


def in_range(met: DataFrame, ranges: DataFrame) -> DataFrame:
    return with_range(met, ranges).drop("range_start", "range_end")


# ------------------------------------------------------------- completeness

def expected_count(start: Column, end: Column, step: timedelta, end_inclusive: bool = True) -> Column:
    """Number of stamps from start to end, without laying them out."""
    span = tg.epoch_micros(end) - tg.epoch_micros(start) - (0 if end_inclusive else 1)
    return F.greatest(F.floor(span / F.lit(tg.to_micros(step))) + 1, F.lit(0)).cast("long")


def on_grid(ts: Column, start: Column, end: Column, step: timedelta, end_inclusive: bool = True) -> Column:
    offset = tg.epoch_micros(ts) - tg.epoch_micros(start)
    before_end = ts <= end if end_inclusive else ts < end
    return is_true((ts >= start) & before_end & (F.pmod(offset, F.lit(tg.to_micros(step))) == 0))


def percent(missing: Column, expected: Column) -> Column:
    return F.round(F.coalesce((1 - F.try_divide(missing, expected)) * 100, F.lit(0.0)), 2)


def completeness(
    df: DataFrame, ranges: DataFrame, step: timedelta = tg.TEN_MINUTES, by=(), end_inclusive: bool = True
) -> DataFrame:
    """Expected and missing stamps and the percentage present, per month (and ``by``).

    Counts distinct stamps that lie on the grid; a month without rows misses all.
    """
    counts = presence(df, ranges, step, by, end_inclusive)
    found = F.coalesce(P.steps_counted(F.col(SEEN)), F.lit(0))
    expected = expected_count(F.col("range_start"), F.col("range_end"), step, end_inclusive)
    return counts.select(
        "period",
        *by,
        (expected - found).alias("missing_count"),
        expected.alias("total_expected"),
        percent(expected - found, expected).alias("completeness_percentage"),
    )


SEEN = "_seen"


def presence(df: DataFrame, ranges: DataFrame, step: timedelta, by=(), end_inclusive: bool = True) -> DataFrame:
    """The ranges with a bitmap ``_seen`` of the steps that have rows, per month (and ``by``).

    One shuffle: of one bitmap per task for the months, of the rows with ``by``. A month without rows has
    no bitmap, and with ``by`` no row.
    """
    seen = P.steps_seen(F.col(STEP), step).alias(SEEN)
    rows = with_steps(df, ranges, step, end_inclusive).select("period", *by, STEP)
    if by:
        return together(rows, "period", *by).groupBy("period", *by).agg(seen).join(months(ranges), "period")
    return ranges.join(rows.groupBy("period").agg(seen), "period", "left")


def together(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows moved to their group before its bitmap is made.

    A group of a station and month has a few rows in a task, and a bitmap takes kilobytes whatever it
    holds: with one per group and task the bitmaps would outgrow the rows by far.
    """
    return rows.repartition(*keys)


STEP = "_step"


def with_steps(df: DataFrame, ranges: DataFrame, step: timedelta, end_inclusive: bool = True) -> DataFrame:
    """Rows with the number of their step in the range of their month; NULL beside the grid."""
    start, end, ts = F.col("range_start"), F.col("range_end"), F.col("TimeStamp")
    number = F.when(on_grid(ts, start, end, step, end_inclusive), P.step_number(ts, start, step))
    return df.join(months(ranges), "period").withColumn(STEP, number).drop("range_start", "range_end")


def at_step(number: Column, step: timedelta) -> Column:
    return F.timestamp_add("MICROSECOND", number * F.lit(tg.to_micros(step)), F.col("range_start"))


def missing_timestamps(df: DataFrame, ranges: DataFrame, step: timedelta = tg.TEN_MINUTES, by=()) -> DataFrame:
    """Expected stamps without a row, per month (and per value of ``by`` that has rows)."""
    expected = expected_count(F.col("range_start"), F.col("range_end"), step)
    gaps = presence(df, ranges, step, by).withColumn(STEP, F.explode(P.steps_absent(F.col(SEEN), expected)))
    return gaps.select("period", *by, at_step(F.col(STEP), step).alias("TimeStamp"))


def first_ten(missing: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the count, the first ten missing stamps as text, and how many more there are.

    Only ten stamps of a group are gathered; a group has at most the stamps of a month.
    """
    group = Window.partitionBy(*keys)
    more = F.array(F.concat(F.lit("... and "), (F.col("count") - 10).cast("string"), F.lit(" more")))
    return (
        missing.withColumns(
            {"_n": F.row_number().over(group.orderBy("TimeStamp")), "count": F.count(F.lit(1)).over(group)}
        )
        .where(F.col("_n") <= 10)
        .groupBy(*keys, "count")
        .agg(F.array_sort(F.collect_list(tg.iso(F.col("TimeStamp")))).alias("_head"))
        .select(
            *keys,
            "count",
            F.when(F.col("count") > 10, F.concat("_head", more)).otherwise(F.col("_head")).alias("missing_timestamps"),
        )
    )


def completeness_issue(missing: DataFrame, keys: list[str], ranges: DataFrame, step: timedelta) -> DataFrame:
    expected = expected_count(F.col("range_start"), F.col("range_end"), step)
    return (
        first_ten(missing, keys)
        .join(months(ranges), "period")
        .withColumn("total_expected", expected)
        .withColumn("completeness_pct", percent(F.col("count"), expected))
    )


def system_gaps(met: DataFrame, ranges: DataFrame, step: timedelta, sensors=S.MET_SENSORS) -> DataFrame:
    """Stamps missing for the whole site, or only for one sensor, as rows ``period, sensor, TimeStamp``.

    The site's bitmaps, one of the rows and one per sensor, are those of the stations taken together:
    a task hands on one row per month. A month without any row in its range is not reported stamp by stamp.
    """
    sensors = [s for s in sensors if f"{s}_mean" in met.columns]
    number, expected = F.col(STEP), expected_count(F.col("range_start"), F.col("range_end"), step)
    inside = with_steps(in_range(met, ranges), ranges, step)
    seen = {s: P.steps_seen(F.when(F.col(f"{s}_mean").isNotNull(), number), step) for s in sensors}
    site = inside.groupBy("period").agg(P.steps_seen(number, step).alias(SEEN), *[c.alias(s) for s, c in seen.items()])
    nothing = P.steps_absent(F.col(SEEN), expected)
    only = {s: F.array_except(P.steps_absent(F.col(s), expected), nothing) for s in sensors}

    def named(sensor: str, steps: Column) -> Column:
        return F.transform(steps, lambda i: F.struct(F.lit(sensor).alias("sensor"), i.alias(STEP)))

    gaps = F.flatten(F.array(*[named(sensor, steps) for sensor, steps in {GLOBAL: nothing, **only}.items()]))
    rows = ranges.join(site, "period").select("period", "range_start", F.inline(gaps))
    return rows.select("period", at_step(F.col(STEP), step).alias("TimeStamp"), "sensor")


def system_completeness(met: DataFrame, ranges: DataFrame, step: timedelta = tg.TEN_MINUTES) -> DataFrame:
    """Issues for stamps without any row, and per sensor for stamps where only that sensor is missing."""
    issues = completeness_issue(system_gaps(met, ranges, step), ["period", "sensor"], ranges, step)
    reported = (F.col("sensor") != GLOBAL) | (F.col("completeness_pct") < 100.0)
    return as_issues(
        issues.where(reported).withColumn("type", F.lit("system_completeness")).withColumn("station_id", F.lit("ALL"))
    )


def sensor_only_gaps(met: DataFrame, ranges: DataFrame, step: timedelta = tg.TEN_MINUTES) -> DataFrame:
    """Stamps where rows exist but one sensor has no value at any station."""
    return system_gaps(met, ranges, step).where(F.col("sensor") != GLOBAL)


# ------------------------------------------------------------ value checks

def stuck_flags(
    df: DataFrame, names: dict[str, str], n: int | None = DEFAULT_RUN, exclude_zero: bool = False, keys=tuple(STATION_MONTH)
) -> DataFrame:
    """Flag per sensor, in the column ``names`` gives it, rows in a run of at least ``n`` rows whose present statistics all repeat the row before.

    A missing value ends a run; missing rows do not.  With ``exclude_zero`` a zero
    mean never repeats.  All sensors share three windows over one sort.
    """
    n = n or DEFAULT_RUN
    series = Window.partitionBy(*keys).orderBy("TimeStamp")
    repeats = {}
    for base, out in names.items():
        columns = [f"{base}_{s}" for s in S.STATISTICS if f"{base}_{s}" in df.columns]
        same = F.lit(bool(columns))
        for c in columns:
            same = same & is_true(F.col(c) == F.lag(c).over(series))
        if exclude_zero and f"{base}_mean" in columns:
            same = same & is_true(F.col(f"{base}_mean") != 0)
        repeats[out] = same
    rows = df.withColumns(repeats)
    if n == 1:
        return rows
    # n - 1 repeats in a row mark their last row; the mark then covers the n rows before it.
    # The first row of a station never repeats, so a frame cut off there stays false.
    for how, frame in ((F.min, series.rowsBetween(-(n - 2), 0)), (F.max, series.rowsBetween(0, n - 1))):
        rows = rows.withColumns({out: how(out).over(frame) for out in repeats})
    return rows


def stuck_flag(
    df: DataFrame, base: str, n: int | None = DEFAULT_RUN, exclude_zero: bool = False, keys=tuple(STATION_MONTH), out: str = "stuck"
) -> DataFrame:
    """``stuck_flags`` of one sensor."""
    return stuck_flags(df, {base: out}, n, exclude_zero, keys)


def stuck_column(base: str) -> str:
    return f"_stuck_{base}"


def with_stuck_flags(met: DataFrame, n: int | None, exclude_zero: bool, sensors=S.MET_SENSORS) -> DataFrame:
    return stuck_flags(met, {base: stuck_column(base) for base in sensors}, n, exclude_zero)


def out_of_range(column: str, low: float, high: float) -> Column:
    return is_true(~F.col(column).between(low, high))


class Check:
    """One value check: where it fires and how it is reported."""

    def __init__(self, kind: str, fires: Column, sensor=None, column=None, sample=None, bounds=(None, None)):
        self.kind, self.fires, self.sensor, self.column = kind, fires, sensor, column
        self.sample, self.bounds = sample, bounds


def empty_checks(columns, bounds=S.MET_BOUNDS) -> list[Check]:
    means = [f"{s}_mean" for s in bounds if f"{s}_mean" in columns]
    if not means:
        return []
    return [Check("empty_row", F.coalesce(*means).isNull(), sensor="ALL")]


def gap_checks(columns, bounds=S.MET_BOUNDS) -> list[Check]:
    means = [f"{s}_mean" for s in bounds if f"{s}_mean" in columns]
    if not means:
        return []
    some = F.coalesce(*means).isNotNull()
    return [Check("sensor_gap", some & F.col(m).isNull(), sensor=m.removesuffix("_mean")) for m in means]


def stuck_checks(columns, bounds=S.MET_BOUNDS) -> list[Check]:
    out = []
    for base in bounds:
        if stuck_column(base) in columns:
            sample = F.col(f"{base}_mean") if f"{base}_mean" in columns else F.lit(None).cast("double")
            out.append(Check("stuck_value", F.col(stuck_column(base)), sensor=base, sample=sample))
    return out


def range_checks(columns, bounds=S.MET_BOUNDS) -> list[Check]:
    return [
        Check("out_of_range", out_of_range(f"{base}_{s}", low, high), column=f"{base}_{s}", bounds=(low, high))
        for base, (low, high) in bounds.items()
        for s in ("mean", "min", "max")
        if f"{base}_{s}" in columns
    ]


def issue(**fields) -> Column:
    """A struct of the value columns of an issue; those not given are NULL."""
    names = [n for n in ISSUE_FIELDS if n not in ("period", "station_id")]
    return F.struct(*[fields.get(n, F.lit(None)).cast(ISSUE_TYPES[n]).alias(n) for n in names])


def check_aggregates(checks: list[Check]) -> tuple[list[Column], list[Column]]:
    """Conditional aggregates of the checks, and the issue each one makes of them."""
    ts = F.col("TimeStamp")
    aggregates, entries = [], []
    for i, c in enumerate(checks):
        aggregates += [
            F.count_if(c.fires).alias(f"_n{i}"),
            F.min(F.when(c.fires, ts)).alias(f"_a{i}"),
            F.max(F.when(c.fires, ts)).alias(f"_z{i}"),
        ]
        if c.sample is not None:
            aggregates.append(F.min_by(c.sample, F.when(c.fires, ts)).alias(f"_s{i}"))
        entry = issue(
            type=F.lit(c.kind),
            sensor=F.lit(c.sensor),
            column=F.lit(c.column),
            count=F.col(f"_n{i}"),
            range_start=F.col(f"_a{i}"),
            range_end=F.col(f"_z{i}"),
            sample_value=F.col(f"_s{i}") if c.sample is not None else F.lit(None),
            bound_low=F.lit(c.bounds[0]),
            bound_high=F.lit(c.bounds[1]),
        )
        entries.append(F.when(F.col(f"_n{i}") > 0, entry))
    return aggregates, entries


def per_station(
    met: DataFrame, aggregates: list[Column], entries: list[Column], more=(), derived: dict[str, Column] | None = None
) -> DataFrame:
    """One aggregate per station and month, then one row per issue."""
    return (
        met.groupBy(*STATION_MONTH, *more)
        .agg(*aggregates)
        .withColumns(derived or {})
        .select("period", F.col("StationId").cast("string").alias("station_id"), F.inline(F.array_compact(F.array(*entries))))
        .select(*ISSUE_FIELDS)
    )


def count_checks(met: DataFrame, checks: list[Check]) -> DataFrame:
    return per_station(met, *check_aggregates(checks))


def presence_aggregate(step: timedelta) -> tuple[Column, dict[str, Column], Column]:
    """The bitmap of the steps present, the steps absent, and the issue made of it.

    What is missing follows without laying the grid of stations and stamps out.
    """
    ts, start, end = F.col("TimeStamp"), F.col("range_start"), F.col("range_end")
    micros = tg.to_micros(step)
    seen = P.steps_seen(F.when(on_grid(ts, start, end, step), P.step_number(ts, start, step)), step).alias(SEEN)
    expected = expected_count(start, end, step)
    derived = {"_absent": P.steps_absent(F.col(SEEN), expected)}
    absent = F.col("_absent")
    count = F.size(absent).cast("long")
    head = F.transform(
        F.slice(absent, 1, 10), lambda i: tg.iso(F.timestamp_add("MICROSECOND", i * F.lit(micros), start))
    )
    more = F.array(F.concat(F.lit("... and "), (count - 10).cast("string"), F.lit(" more")))
    share = percent(count, expected)
    entry = issue(
        type=F.lit("completeness"),
        count=count,
        total_expected=expected,
        completeness_pct=share,
        missing_timestamps=F.when(count > 10, F.concat(head, more)).otherwise(head),
        range_start=start,
        range_end=end,
    )
    return seen, derived, F.when(share < 100.0, entry)


def station_completeness(met: DataFrame, ranges: DataFrame, step: timedelta = tg.TEN_MINUTES) -> DataFrame:
    """Issues for stamps missing at one station."""
    seen, derived, entry = presence_aggregate(step)
    rows = with_range(met, ranges).select(*STATION_MONTH, "TimeStamp", "range_start", "range_end")
    return per_station(together(rows, *STATION_MONTH), [seen], [entry], ("range_start", "range_end"), derived)


def empty_rows(met: DataFrame, bounds=S.MET_BOUNDS) -> DataFrame:
    """Rows present with no sensor value at all."""
    return count_checks(met, empty_checks(met.columns, bounds))


def sensor_gaps(met: DataFrame, bounds=S.MET_BOUNDS) -> DataFrame:
    """Rows where one sensor is missing and another is not."""
    return count_checks(met, gap_checks(met.columns, bounds))


def stuck_issues(met: DataFrame, n: int | None = DEFAULT_RUN, exclude_zero: bool = False, bounds=S.MET_BOUNDS) -> DataFrame:
    flagged = with_stuck_flags(met, n, exclude_zero, tuple(bounds))
    return count_checks(flagged, stuck_checks(flagged.columns, bounds))


def range_issues(met: DataFrame, bounds=S.MET_BOUNDS) -> DataFrame:
    return count_checks(met, range_checks(met.columns, bounds))


def scan_met(
    met: DataFrame,
    ranges: DataFrame,
    bounds=S.MET_BOUNDS,
    n: int | None = DEFAULT_RUN,
    exclude_zero: bool = False,
    step: timedelta = tg.TEN_MINUTES,
) -> DataFrame:
    """All issues of the scanned months.

    Two passes: one per stamp for the site, one per station for everything else.
    """
    rows = with_stuck_flags(with_range(met, ranges), n, exclude_zero, tuple(bounds))
    checks = [c for make in (empty_checks, gap_checks, stuck_checks, range_checks) for c in make(rows.columns, bounds)]
    aggregates, entries = check_aggregates(checks)
    seen, derived, incomplete = presence_aggregate(step)
    stations = per_station(rows, [seen, *aggregates], [incomplete, *entries], ("range_start", "range_end"), derived)
    return system_completeness(met, ranges, step).unionByName(stations)


def nullify_met(met: DataFrame, bounds=S.MET_BOUNDS, n: int | None = DEFAULT_RUN, exclude_zero: bool = False) -> DataFrame:
    """Remove stuck values (all statistics of the sensor) and values out of bounds (mean, min, max)."""
    flagged = with_stuck_flags(met, n, exclude_zero, tuple(bounds))
    cleaned = {}
    for base, (low, high) in bounds.items():
        for stat in S.STATISTICS:
            name = f"{base}_{stat}"
            if name in met.columns:
                bad = F.col(stuck_column(base))
                if stat != "stddev":
                    bad = bad | out_of_range(name, low, high)
                cleaned[name] = F.when(~bad, F.col(name)).alias(name)
    return flagged.select(*[cleaned.get(c, F.col(f"`{c}`")) for c in met.columns])


# ---------------------------------------------------------------- reporting

def issue_summary(issues: DataFrame, ranges: DataFrame) -> DataFrame:
    """Totals per issue type, months scanned and months with issues: one row."""
    names = {
        "stuck_value": "stuck_values_count",
        "out_of_range": "out_of_range_count",
        "completeness": "completeness_issues_count",
        "system_completeness": "system_issues_count",
        "empty_row": "empty_rows_count",
        "sensor_gap": "sensor_gaps_count",
    }
    marked = issues.select("period", "type").unionByName(ranges.select("period", F.lit("scanned").alias("type")))
    per_month = marked.groupBy("period", "type").agg(F.count(F.lit(1)).alias("n"))
    kind, found = F.col("type"), F.col("type") != "scanned"

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return per_month.agg(
        total(~found).alias("total_files_scanned"),
        total(found).alias("total_issues"),
        F.count_distinct(F.when(found, F.col("period"))).alias("files_with_issues"),
        *[total(kind == k).alias(v) for k, v in names.items()],
    )


def severity() -> Column:
    rank = F.when((F.col("type") == "system_completeness") & (F.col("sensor") == GLOBAL), 0.0).when(
        F.col("type") == "system_completeness", 1.0
    )
    for kind, value in SEVERITY:
        rank = rank.when(F.col("type") == kind, value)
    return rank.otherwise(99.0)


def order_issues(issues: DataFrame) -> DataFrame:
    """Most severe first, within each month."""
    return issues.withColumn("severity", severity()).orderBy("period", "severity", "station_id", "sensor", "column")
