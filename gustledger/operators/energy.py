"""Energy: plausibility filters, counter gaps, operational turbines, potential energy.

The wide frame has one row per ``period, StationId, TimeStamp``.  Windows over a
station within a month, or over a stamp, hold at most the stamps of a month or the
stations of the farm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustledger.functions.numbers import half_even
from gustledger.functions.nulls import clip_zero, differs, is_true, or_zero
from gustledger.sources import schemas as S

ACCUM = "wtc_kWG1TotE_accum"
COUNTER = "wtc_kWG1TotE_endvalue"

# Method labels of the result.
PRODUCED = "Epot=EnergyProduced"
AVERAGE = "AverageWithWakeLossAdjustments"
ANEMOMETER = "Anemometer"
STATISTICS = "SWE"

STATION_MONTH = ["period", "StationId"]
STAMP = ["period", "TimeStamp"]


def sanity_filter(sig: DataFrame, kind: str, bounds: dict | None = None) -> DataFrame:
    """Rows whose checked values are all present and within bounds."""
    for column, (low, high) in (bounds or S.SANITY_BOUNDS[kind]).items():
        sig = sig.where(F.col(column).between(low, high))
    return sig


def producing(counter: DataFrame, grid_power: DataFrame, source: str = "energy") -> DataFrame:
    """Cells with production, by counter or by mean power."""
    if source == "power":
        return grid_power.where(F.col("wtc_ActPower_mean") > 0).select("period", "StationId", "TimeStamp")
    return counter.where(F.col(ACCUM) > 0).select("period", "StationId", "TimeStamp")


def energy_to_use(source: str = "energy") -> Column:
    """Energy of an interval: the counter, or mean power over six with negatives as zero."""
    return clip_zero(F.col("wtc_ActPower_mean") / 6) if source == "power" else F.col(ACCUM)


# ----------------------------------------------------------- counter gaps

def energy_gaps(res: DataFrame, keys=tuple(STATION_MONTH)) -> DataFrame:
    """Describe the run of missing energy a row belongs to.

    Adds ``gap`` (number of the run within its station, NULL outside gaps),
    ``gap_rows``, and the counter before, the counter after and the energy after.
    The neighbours are kept as structs, since their values may be missing too.

    ``_run`` counts the known rows before a row: a gap and the known row that ends it
    share it, so one window per run sees both, and nothing is read backwards.
    """
    missing = F.col(ACCUM).isNull()
    past = Window.partitionBy(*keys).orderBy("TimeStamp").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*keys, "_run")
    known = F.when(~missing, F.struct(F.col(COUNTER).alias("counter"), F.col(ACCUM).alias("energy")))
    marked = res.withColumns({"_run": F.count(ACCUM).over(past), "_past": F.last(known, ignorenulls=True).over(past)})
    marked = marked.withColumns({"_end": F.max(known).over(run), "_rows": F.count(F.when(missing, 1)).over(run)})
    return marked.withColumns(
        {
            "gap": F.when(missing, F.col("_run")),
            "gap_rows": F.when(missing, F.col("_rows")),
            "counter_before": F.when(missing, F.col("_past.counter")),
            "counter_after": F.when(missing, F.col("_end.counter")),
            "energy_after": F.when(missing, F.col("_end.energy")),
        }
    ).drop("_past", "_end", "_rows")


def gap_energy(max_per_interval: float) -> Column:
    """Energy to spread over a gap: NULL leaves the gap open, zero or less fills it with zero."""
    caught_up = F.col("counter_after") - F.col("counter_before")
    plausible = (caught_up >= 0) & (caught_up <= (F.col("gap_rows") + 1) * F.lit(max_per_interval))
    rest = F.when(caught_up == 0, 0.0).otherwise(caught_up - or_zero(F.col("energy_after")))
    return F.when(plausible, rest)


def impute_energy(
    res: DataFrame, max_per_interval: float = 450.0, full_alarm: float = 600.0, keys=tuple(STATION_MONTH), keep_gap: bool = False
) -> DataFrame:
    """Fill missing energy from the cumulative counter.

    The counter rise over a gap, less the energy of the row after it, goes in equal
    parts to the gap rows not fully under alarm.  Gaps at the ends, with unknown
    counters, falling counters or implausible rises stay open.  Without the counter
    column nothing is done.
    """
    if "Energy_Source" not in res.columns:
        res = res.withColumn("Energy_Source", F.lit("actual"))
    if COUNTER not in res.columns:
        return res
    in_gap = F.col("gap").isNotNull()
    free = in_gap & (is_true(F.col("EffectiveAlarmTime") < full_alarm) | F.col("EffectiveAlarmTime").isNull())
    run = Window.partitionBy(*keys, "_run")
    gaps = energy_gaps(res, keys).withColumns(
        {"_free": free, "_free_rows": F.count(F.when(free, 1)).over(run), "_energy": F.when(in_gap, gap_energy(max_per_interval))}
    )
    spread = (F.col("_energy") > 0) & F.col("_free")
    part = half_even(F.try_divide("_energy", F.col("_free_rows")))
    out = gaps.withColumns(
        {
            "Energy_Source": F.when(is_true(spread), "interpolated").otherwise(F.col("Energy_Source")),
            ACCUM: F.when(F.col("_energy").isNull(), F.col(ACCUM)).when(spread, part).otherwise(0.0),
        }
    ).drop("_run", "_free")
    if keep_gap:
        return out.withColumnRenamed("_energy", "gap_energy").withColumnRenamed("_free_rows", "free_rows")
    return out.drop("gap", "gap_rows", "counter_before", "counter_after", "energy_after", "_free_rows", "_energy")


def impute_stats(res: DataFrame, max_per_interval: float = 450.0, full_alarm: float = 600.0, keys=tuple(STATION_MONTH)) -> DataFrame:
    """Number of filled intervals and the energy recovered (each gap counted once)."""
    rows = impute_energy(res, max_per_interval, full_alarm, keys, keep_gap=True)
    filled = F.col("gap").isNotNull() & F.col("gap_energy").isNotNull()
    per_row = F.when((F.col("gap_energy") > 0) & (F.col("Energy_Source") == "interpolated"), F.col("gap_energy") / F.col("free_rows"))
    return rows.agg(
        F.count(F.when(filled, 1)).alias("imputed_intervals"),
        F.coalesce(F.sum(F.when(filled, per_row)), F.lit(0.0)).alias("imputed_energy"),
    )


# ------------------------------------------------------- potential energy

def operational(energy: str = "Energy_To_Use") -> Column:
    """Producing, no alarm, in operation, no power-limit warning, and not visibly curtailed.

    Unknown curtailment with high power counts as operational.
    """
    curtailed = F.col("wtc_PowerRed_timeon")
    return is_true(
        (F.col(energy) > 0)
        & (F.col("EffectiveAlarmTime") == 0)
        & (F.col("wtc_ScInOper_timeon") > 0)
        & (F.col("Duration 2006(s)") == 0)
        & (is_true(curtailed == 0) | is_true(differs(curtailed, 0) & (F.col("wtc_ActPower_max") > 2200)))
    )


def correction_factor(n: Column, total: int = S.TURBINES, loss: float = 0.08) -> Column:
    """Wake correction for ``n`` running turbines."""
    return F.try_divide(F.lit(1.0 - loss), F.lit(1.0) - F.lit(loss) * (n - 1) / F.lit(float(total - 1)))


def running_energy(running: Column) -> tuple[Column, Column]:
    """Aggregates over the running turbines: mean energy and their number."""
    energy = F.when(running, F.col("Energy_To_Use"))
    return F.avg(energy), F.count(energy)


def potential_energy(res: DataFrame, total: int = S.TURBINES, loss: float = 0.08) -> DataFrame:
    """Per stamp: corrected mean energy of the running turbines, the factor and their number."""
    mean, count = running_energy(operational())
    factor = correction_factor(F.col("Available Turbines"), total, loss)
    return (
        res.groupBy(*STAMP)
        .agg(mean.alias("_mean"), count.alias("Available Turbines"))
        .where(F.col("Available Turbines") > 0)
        .select(
            *STAMP,
            half_even(F.col("_mean") * factor).alias("Epot"),
            factor.alias("Correction Factor"),
            "Available Turbines",
        )
    )


#: Winds of curve knots, in metres per second, that are taken for real; a knot beyond is refused.
CURVE_RANGE = 200


def curve_cells(curve: DataFrame) -> DataFrame:
    """Power curve as straight pieces, one row per piece and whole wind speed it touches.

    Knots may stand anywhere within CURVE_RANGE. ``low`` and ``high`` bound the winds of a piece;
    the first and the last one reach to infinity.
    """
    wind = F.col("Wind").cast("double")
    knots = F.array_sort(F.collect_set(F.struct(wind.alias("Wind"), "Power")))
    pieces = curve.agg(knots.alias("k"), F.min(wind).alias("first"), F.max(wind).alias("top")).select(
        "first",
        "top",
        F.explode(
            F.zip_with(
                F.slice("k", 1, F.size("k") - 1),
                F.slice("k", 2, F.size("k") - 1),
                lambda a, b: F.struct(
                    a.Wind.alias("w0"), a.Power.alias("p0"), b.Wind.alias("w1"), b.Power.alias("p1")
                ),
            )
        ).alias("s"),
    )
    w0, w1 = F.col("s.w0"), F.col("s.w1")
    twice = F.raise_error(F.lit("the power curve has two powers for one wind speed"))
    beyond = F.raise_error(F.lit(f"the power curve has a wind beyond {CURVE_RANGE} metres per second"))
    inside = (w0 >= -CURVE_RANGE) & (w1 <= CURVE_RANGE)
    cells = F.when(~inside, beyond).when(w0 < w1, F.sequence(F.floor(w0).cast("int"), F.ceil(w1).cast("int") - 1)).otherwise(twice)
    low = F.when(w0 == F.col("first"), float("-inf")).otherwise(w0)
    high = F.when(w1 == F.col("top"), float("inf")).otherwise(w1)
    return pieces.select("s.*", low.alias("_low"), high.alias("_high"), F.explode(cells).alias("_at"))


def on_piece(wind: Column) -> Column:
    slope = (F.col("p1") - F.col("p0")) / (F.col("w1") - F.col("w0"))
    return F.col("p0") + slope * (wind - F.col("w0"))


def curve_power(df: DataFrame, curve: DataFrame, wind: str, out: str) -> DataFrame:
    """Add the curve's power at ``wind``: straight lines between knots, extended beyond both ends.

    The join is an equality on the whole wind speed, with winds outside the curve
    moved to its first or last piece, and among the few pieces of that cell the one
    that holds the wind.  The pieces are always broadcast: CURVE_RANGE bounds the cells,
    and shuffling the rows by so few keys would pile them up.
    """
    speed = F.col("Wind").cast("double")
    ends = curve.agg(
        F.struct(F.floor(F.min(speed)).cast("int").alias("first"), (F.ceil(F.max(speed)).cast("int") - 1).alias("last")).alias("e")
    ).scalar()
    cells = F.broadcast(curve_cells(curve))
    cell = F.greatest(ends.first, F.least(ends.last, F.floor(F.col(wind)).cast("int")))
    held = (F.col("_cell") == F.col("_at")) & (F.col(wind) >= F.col("_low")) & (F.col(wind) < F.col("_high"))
    return (
        df.withColumn("_cell", F.when(F.col(wind).isNotNull(), cell))
        .join(cells, held, "left")
        .withColumn(out, on_piece(F.col(wind)))
        .drop("_cell", "_at", "_low", "_high", "w0", "p0", "w1", "p1")
    )


def energy_from_wind(df: DataFrame, curve: DataFrame, out: str = "wind_energy") -> DataFrame:
    """Energy of a ten-minute interval from the turbine's own wind speed; NULL without wind."""
    return curve_power(df, curve, "wtc_AcWindSp_mean", out).withColumn(out, F.col(out) / 6)


def statistical_energy(curve: DataFrame, distribution: DataFrame, season: DataFrame, efficiency: float = 0.92) -> DataFrame:
    """Expected energy of a ten-minute interval per calendar month, from the wind statistics."""
    bins = distribution.where(F.col("bin").between(1, 25)).withColumn("_wind", F.col("bin").cast("double"))
    yearly = curve_power(bins, curve, "_wind", "_power").agg(
        F.sum(F.col("_power") * F.col("value")) * F.lit(efficiency)
    ).scalar()
    return season.select("month", (yearly / F.lit(8760.0) / F.lit(6.0) * F.col("value")).alias("statistical_energy"))


def running_means(res: DataFrame) -> DataFrame:
    """Per stamp the mean energy and the number of the running turbines, as ``_mean`` and ``_count``.

    A task adds up its own rows of a stamp first: one row per stamp and task is shuffled.
    """
    mean, count = running_energy(operational())
    return res.groupBy(*STAMP).agg(mean.alias("_mean"), count.alias("_count"))


def potential_cascade(
    res: DataFrame, curve: DataFrame, stat: DataFrame, total: int = S.TURBINES, loss: float = 0.08, keys=tuple(STAMP)
) -> DataFrame:
    """Choose the potential energy of every row and name the method, with averages over the stamp by a window."""
    stamp = Window.partitionBy(*keys)
    mean, count = running_energy(F.col("_running"))
    rows = res.withColumn("_running", operational()).withColumns({"_mean": mean.over(stamp), "_count": count.over(stamp)})
    return choose_potential(rows.drop("_running"), curve, stat, total, loss)


def choose_potential(rows: DataFrame, curve: DataFrame, stat: DataFrame, total: int = S.TURBINES, loss: float = 0.08) -> DataFrame:
    """Choose the potential energy of rows that carry ``_mean`` and ``_count`` of their stamp, and name the method.

    1. a running turbine: its own energy; 2. else the corrected mean of the running
    turbines at that stamp, or the own energy if larger; 3. else the power curve at
    the own wind; 4. else the wind statistics of the month; 3 and 4 at least the own energy.
    """
    own = F.col("Energy_To_Use")
    rows = rows.withColumns({"_running": operational(), "_month": F.month("TimeStamp")})
    rows = rows.withColumn("Available Turbines", F.when(F.col("_count") > 0, F.col("_count")))
    rows = rows.withColumn("Correction Factor", correction_factor(F.col("Available Turbines"), total, loss))
    rows = rows.withColumn("_average", half_even(F.col("_mean") * F.col("Correction Factor")))
    rows = energy_from_wind(rows, curve, "_by_wind")
    season = stat.select(F.col("month").alias("_month"), F.col("statistical_energy").alias("_by_season"))
    rows = rows.join(F.broadcast(season), "_month", "left")  # one row per month of the year
    average, wind = F.col("_average"), F.col("_by_wind")
    above = is_true(average < own)
    epot = (
        F.when(F.col("_running"), own)
        .when(average.isNotNull(), F.when(above, own).otherwise(average))
        .when(wind.isNotNull(), F.greatest(wind, or_zero(own)))
        .otherwise(F.when(F.col("_by_season").isNotNull(), F.greatest(F.col("_by_season"), or_zero(own))))
    )
    method = (
        F.when(F.col("_running") | above, PRODUCED)
        .when(average.isNotNull(), AVERAGE)
        .when(wind.isNotNull(), ANEMOMETER)
        .otherwise(STATISTICS)
    )
    return rows.withColumns({"Epot": epot, "Epot_Method": method}).drop(
        "_running", "_mean", "_count", "_average", "_by_wind", "_by_season", "_month"
    )
