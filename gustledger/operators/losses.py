"""Loss accounting: split lost energy by cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustledger.functions.nulls import clip_zero, is_true, or_zero, share

STATION_MONTH = ["period", "StationId"]
STAMP = ["period", "TimeStamp"]
INTERVAL_SECONDS = 600.0


def energy_loss() -> Column:
    return clip_zero(or_zero(F.col("Epot")) - or_zero(F.col("Energy_To_Use")))


def loss_by_party(res: DataFrame) -> DataFrame:
    """Total loss, the shares of both parties by alarm seconds, and the rest."""
    zero, one, loss = F.col("Period 0(s)"), F.col("Period 1(s)"), F.col("EL")
    return (
        res.withColumn("EL", energy_loss())
        .withColumn("ELX", share(zero, one, loss))
        .withColumn("ELNX", share(one, zero, loss))
        .withColumn("EL_indefini", loss - (F.col("ELX") + F.col("ELNX")))
    )


def take_rest(res: DataFrame, condition: Column, out: str) -> DataFrame:
    """Move the whole unassigned rest to ``out`` where the condition holds."""
    rest = F.col("EL_indefini")
    return res.withColumn(out, F.when(is_true((rest > 0) & condition), rest).otherwise(0.0)).withColumn(
        "EL_indefini", or_zero(rest) - F.col(out)
    )


def loss_curtailment(res: DataFrame) -> DataFrame:
    return take_rest(res, (F.col("wtc_PowerRed_timeon") > 0) & (F.col("wtc_ActPower_max") > 2300), "EL_PowerRed")


def loss_power_limit(res: DataFrame) -> DataFrame:
    return take_rest(res, F.col("Duration 2006(s)") > 0, "EL_2006")


def split_losses(res: DataFrame) -> DataFrame:
    """Loss by party, then curtailment and the power-limit warning out of the rest."""
    return loss_power_limit(loss_curtailment(loss_by_party(res)))


def neighbour_values(res: DataFrame, keys=tuple(STAMP)) -> DataFrame:
    """Wind, minimum power and alarm time of the previous and next station at the same stamp."""
    row = Window.partitionBy(*keys).orderBy("StationId")
    pick = {
        "wind_speed": "wtc_AcWindSp_mean",
        "min_power": "wtc_ActPower_min",
        "alarm_period": "EffectiveAlarmTime",
    }
    near = {f"{name}_prev_turbine": F.lag(column).over(row) for name, column in pick.items()}
    near |= {f"{name}_next_turbine": F.lead(column).over(row) for name, column in pick.items()}
    own = F.col("wtc_AcWindSp_mean")
    return res.withColumns(near).withColumns(
        {
            "wind_speed_diff_prev_turbine": F.col("wind_speed_prev_turbine") - own,
            "wind_speed_diff_next_turbine": F.col("wind_speed_next_turbine") - own,
        }
    )


def neighbours_produce() -> Column:
    """Both neighbours produce, or one produces while the other is under alarm."""
    power_before, power_after = F.col("min_power_prev_turbine") > 0, F.col("min_power_next_turbine") > 0
    alarm_before, alarm_after = F.col("alarm_period_prev_turbine") > 0, F.col("alarm_period_next_turbine") > 0
    return (
        is_true(power_before & power_after) | is_true(power_before & alarm_after) | is_true(power_after & alarm_before)
    )


def local_wind_drop() -> Column:
    """Clearly less wind than at both neighbours, with wind enough at one of the three."""
    before, after = F.col("wind_speed_prev_turbine"), F.col("wind_speed_next_turbine")
    enough = is_true(before >= 5) | is_true(after >= 5) | is_true(F.col("wtc_AcWindSp_mean") >= 5)
    return is_true(
        (F.col("wind_speed_diff_prev_turbine") > 1) & (F.col("wind_speed_diff_next_turbine") > 1) & enough
    )


def low_wind() -> Column:
    """Unassigned loss that is not a local problem of this turbine."""
    return ~(local_wind_drop() & neighbours_produce()) & is_true(F.col("EL_indefini") > 0)


def wind_patterns(res: DataFrame, keys=tuple(STATION_MONTH)) -> DataFrame:
    """Assign the rest to low wind, to the interval after it, or to the interval after an alarm."""
    series = Window.partitionBy(*keys).orderBy("TimeStamp")
    rest, alarm = F.col("EL_indefini"), F.col("EffectiveAlarmTime")
    rows = res.withColumn("_low", low_wind()).withColumns(
        {
            "_post": F.coalesce(F.lag("_low").over(series), F.col("_low")),
            "_after_alarm": is_true(F.lag(alarm > 0).over(series)),
        }
    )
    low, post = F.col("_low"), F.col("_post")
    start = post & ~low
    recover = ~low & ~post & F.col("_after_alarm") & is_true((rest > 0) & (alarm == 0))
    taken = {}
    for name, seconds, mask in (
        ("EL_wind", "Duration lowind(s)", low),
        ("EL_wind_start", "Duration lowind_start(s)", start),
        ("EL_alarm_start", "Duration alarm_start(s)", recover),
    ):
        taken |= {name: F.when(mask, or_zero(rest)), seconds: F.when(mask, INTERVAL_SECONDS)}
    return rows.withColumns(taken).withColumn("EL_indefini_left", loss_left()).drop("_low", "_post", "_after_alarm")


def loss_left() -> Column:
    taken = or_zero(F.col("EL_wind")) + or_zero(F.col("EL_wind_start")) + or_zero(F.col("EL_alarm_start"))
    return or_zero(F.col("EL_indefini")) - taken


def misassigned(res: DataFrame, text: str = "low wind") -> DataFrame:
    """Loss booked as low wind by the alarm text although the neighbours produce."""
    named = is_true(F.contains(F.col("UK Text"), F.lit(text)))
    return res.withColumn("EL_Misassigned", F.when(named & neighbours_produce(), F.col("ELX")).otherwise(0.0))
