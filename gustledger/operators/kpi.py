"""Monthly and weekly indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg
from gustledger.functions.angles import circular_mean, circular_mean_of
from gustledger.functions.numbers import numeric_columns
from gustledger.sources import schemas as S

ENERGY = "wtc_kWG1TotE_accum"


def between_times(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    return df.where(F.col(column).between(tg.as_ntz(start), tg.as_ntz(end)))


def total(column: str) -> Column:
    """Sum where nothing known counts as zero."""
    return F.coalesce(F.sum(F.col(f"`{column}`")), F.lit(0.0))


def party_energy() -> dict[str, Column]:
    """Energies charged to both parties, and the energy that was possible."""
    own = F.col("ELX") - F.col("EL_Misassigned")
    maker = F.col("ELNX") + F.col("EL_2006") + F.col("EL_PowerRed") + F.col("EL_Misassigned")
    return {"own": own, "maker": maker, "possible": F.col(ENERGY) + own + maker}


def grouped_results(res: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sums per station and month (rounded), and three availability ratios in percent."""
    keys = [c for c in ("period", "StationId") if c in res.columns]
    names = columns or numeric_columns(res, skip=keys)
    sums = res.groupBy(*keys).agg(*[F.round(total(n), 2).alias(n) for n in names])
    made, loss, own, maker = F.col(ENERGY), F.col("EL"), F.col("ELX"), F.col("ELNX")
    party = party_energy()
    wind = F.col("EL_wind") + F.col("EL_wind_start") + F.col("EL_alarm_start")
    return (
        sums.withColumn(
            "MAA_brut",
            F.try_divide(100 * (made + own), made + own + maker + F.col("EL_2006") + F.col("EL_PowerRed")),
        )
        .withColumn("MAA_brut_mis", F.round(F.try_divide(100 * (made + party["own"]), party["possible"]), 2))
        .withColumn("MAA_indefni_adjusted", F.try_divide(100 * (made + own), made + loss - wind))
    )


def numbered(grouped: DataFrame) -> DataFrame:
    """Row number from 1 in station order; a window holds one row per station of the farm."""
    by = [c for c in ("period",) if c in grouped.columns]
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("StationId")
    return grouped.select(F.row_number().over(order).alias("row"), "*")


def mast_columns(res: DataFrame, sensor: str, masts=S.MASTS) -> list[str]:
    return [f"{sensor}_{m}" for m in masts if f"{sensor}_{m}" in res.columns]


def mean_of(columns: list[Column]) -> Column:
    """Mean of the values that are present."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def mean_wind(res: DataFrame, masts=S.MASTS, sensor: str = "met_WindSpeedRot_mean") -> DataFrame:
    """Mean over the masts of each mast's mean wind."""
    columns = mast_columns(res, sensor, masts)
    means = res.agg(*[F.avg(c).alias(c) for c in columns])
    return means.select(F.round(mean_of([F.col(c) for c in columns]), 2).alias("mean_wind"))


def mean_direction(res: DataFrame, masts=S.MASTS, sensor: str = "met_WinddirectionRot_mean") -> DataFrame:
    """Circular mean over the masts of each mast's circular mean direction."""
    columns = mast_columns(res, sensor, masts)
    means = res.agg(*[circular_mean(F.col(c)).alias(c) for c in columns])
    return means.select(circular_mean_of([F.col(c) for c in columns]).alias("mean_direction"))


#: Headings of the weekly report; a farm may have its own.
WEEKLY_NAMES = {
    "maker_energy_pct": "Maker downtime, energy (%)",
    "maker_energy_mwh": "Maker downtime, energy (MWh)",
    "maker_time_pct": "Maker downtime, time (%)",
    "maker_time_hours": "Maker downtime, time (hours)",
    "own_energy_pct": "Operator downtime, energy (%)",
    "own_energy_mwh": "Operator downtime, energy (MWh)",
    "own_time_pct": "Operator downtime, time (%)",
    "own_time_hours": "Operator downtime, time (hours)",
    "mean_wind": "Mean mast wind (m/s)",
    "mean_direction": "Mean mast direction (degrees)",
}


WEEKLY_SUMS = ["EL", "ELX", "ELNX", "EL_2006", ENERGY, "EL_PowerRed", "EL_Misassigned", "Period 0(s)", "Period 1(s)"]


def weekly_kpi(res: DataFrame, start, end, turbines: int = S.TURBINES, masts=S.MASTS) -> DataFrame:
    """One row: energy and time lost per party over a date range, and mast wind where measured."""
    winds, directions = mast_columns(res, "met_WindSpeedRot_mean", masts), mast_columns(res, "met_WinddirectionRot_mean", masts)
    one = between_times(res, "TimeStamp", start, end).agg(
        *[total(c).alias(c) for c in WEEKLY_SUMS],
        *[F.avg(c).alias(c) for c in winds],
        *[circular_mean(F.col(c)).alias(c) for c in directions],
    )
    return _indicators(one, start, end, turbines, winds, directions)


def daily_partials(res: DataFrame, masts=S.MASTS) -> DataFrame:
    """What the reports need of each station and day, so that a week reads days and not stamps.

    ``TimeStamp`` is the start of the day. Energies and seconds are sums under their own names, so
    :func:`top_loss` takes such rows as they are; a wind has its sum and count, a
    direction the sums of its sine and cosine. Stored by month, a day is replaced with its month.
    """
    winds, directions = mast_columns(res, "met_WindSpeedRot_mean", masts), mast_columns(res, "met_WinddirectionRot_mean", masts)
    parts = [F.sum(f"`{c}`").alias(c) for c in WEEKLY_SUMS]
    for c in winds:
        parts += [F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
    for c in directions:
        parts += [F.sum(F.sin(F.radians(c))).alias(f"{c}_sin"), F.sum(F.cos(F.radians(c))).alias(f"{c}_cos")]
    keys = [c for c in ("period", "StationId") if c in res.columns]
    return res.groupBy(*keys, tg.midnight(F.col("TimeStamp")).alias("TimeStamp")).agg(*parts)


def weekly_kpi_of_days(days: DataFrame, start, end, turbines: int = S.TURBINES, masts=S.MASTS) -> DataFrame:
    """:func:`weekly_kpi` from :func:`daily_partials`, for a range of whole days."""
    winds = [c for c in (f"met_WindSpeedRot_mean_{m}" for m in masts) if f"{c}_sum" in days.columns]
    directions = [c for c in (f"met_WinddirectionRot_mean_{m}" for m in masts) if f"{c}_sin" in days.columns]

    def angle(c: str) -> Column:
        return F.pmod(F.degrees(F.atan2(total(f"{c}_sin"), total(f"{c}_cos"))) + 360, F.lit(360.0))

    one = between_times(days, "TimeStamp", start, end).agg(
        *[total(c).alias(c) for c in WEEKLY_SUMS],
        *[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in winds],
        *[angle(c).alias(c) for c in directions],
    )
    return _indicators(one, start, end, turbines, winds, directions)


def _indicators(one: DataFrame, start, end, turbines: int, winds: list[str], directions: list[str]) -> DataFrame:
    days = tg.days_in_range(tg.as_ntz(start), tg.as_ntz(end))
    party = party_energy()
    columns = []
    for name, key, seconds in (("maker", "maker", "Period 1(s)"), ("own", "own", "Period 0(s)")):
        time = F.col(f"`{seconds}`")
        columns += [
            F.round(F.try_divide(100 * party[key], party["possible"]), 2).alias(f"{name}_energy_pct"),
            F.round(party[key] / 1e3, 2).alias(f"{name}_energy_mwh"),
            F.round(100 * time / 3600 / 24 / turbines / days, 2).alias(f"{name}_time_pct"),
            F.round(time / 3600, 2).alias(f"{name}_time_hours"),
        ]
    if winds:
        columns.append(F.round(mean_of([F.col(c) for c in winds]), 2).alias("mean_wind"))
    if directions:
        columns.append(circular_mean_of([F.col(c) for c in directions]).alias("mean_direction"))
    return one.select(*columns)


def weekly_report(kpi: DataFrame, headings: dict[str, str] = WEEKLY_NAMES) -> DataFrame:
    """The weekly row under its report headings, as text; a column without a heading keeps its name."""
    return kpi.select(*[F.format_number(c, 2).alias(headings.get(c, c)) for c in kpi.columns])


def top_loss(res: DataFrame, start=None, end=None, n: int = 15, first_station: int = S.FIRST_STATION) -> DataFrame:
    """The ``n`` turbines with the largest loss in MWh; turbine numbers count from 1.

    Without a range all rows of ``res`` count.
    """
    if start is not None:
        res = between_times(res, "TimeStamp", start, end)
    lost = [F.round(total(c) / 1e3, 2) for c in ("ELNX", "ELX")]
    return (
        res.groupBy((F.col("StationId") - (first_station - 1)).alias("StationId"))
        .agg((lost[0] + lost[1]).alias("lost_mwh"))
        .orderBy(F.desc("lost_mwh"), "StationId")
        .limit(n)
    )
