"""Explicit schemas of the input tables (fixed values: column names and types)."""

from __future__ import annotations

from pyspark.sql import types as T

MET_SENSORS = ("met_WindSpeedRot", "met_WinddirectionRot", "met_Pressure", "met_TemperatureTen")
STATISTICS = ("mean", "min", "max", "stddev")

SIGNAL_COLUMNS: dict[str, tuple[str, ...]] = {
    "met": tuple(f"{sensor}_{stat}" for sensor in MET_SENSORS for stat in STATISTICS),
    "tur": (
        "wtc_AcWindSp_mean",
        "wtc_AcWindSp_stddev",
        "wtc_ActualWindDirection_mean",
        "wtc_ActualWindDirection_stddev",
    ),
    "grd": ("wtc_ActPower_min", "wtc_ActPower_max", "wtc_ActPower_mean"),
    "cnt": (
        "wtc_kWG1Tot_accum",
        "wtc_kWG1TotE_accum",
        "wtc_kWG1TotI_accum",
        "wtc_kWG1Tot_endvalue",
        "wtc_kWG1TotE_endvalue",
        "wtc_BoostKWh_endvalue",
        "wtc_BostkWhS_endvalue",
    ),
    "din": ("wtc_PowerRed_timeon",),
    "flg": ("wtc_ScInOper_timeon",),
}

ALARM_COLUMNS = ("TimeOn", "TimeOff", "StationNr", "Alarmcode", "Parameter")


def signal_schema(kind: str) -> T.StructType:
    """Schema of a signal text file; the time stamp is parsed by readers.load_signal."""
    fields = [T.StructField("TimeStamp", T.StringType()), T.StructField("StationId", T.LongType())]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in SIGNAL_COLUMNS[kind]])


# Times stay text here: the log mixes two formats, see readers.load_alarms.
ALARM_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.LongType()),
        T.StructField("TimeOn", T.StringType()),
        T.StructField("TimeOff", T.StringType()),
        T.StructField("StationNr", T.LongType()),
        T.StructField("Alarmcode", T.DoubleType()),
        T.StructField("Parameter", T.StringType()),
    ]
)

CODE_SCHEMA = T.StructType(
    [
        T.StructField("Number", T.DoubleType()),
        T.StructField("Error Type", T.DoubleType()),
        T.StructField("UK Text", T.StringType()),
    ]
)

ADJUSTMENT_FIELDS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("alarm_code", T.LongType()),
        T.StructField("station_nr", T.LongType()),
        T.StructField("time_on", T.StringType()),
        T.StructField("time_off", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("last_updated", T.StringType()),
    ]
)

ADJUSTMENT_DOCUMENT = T.StructType([T.StructField("adjustments", T.ArrayType(ADJUSTMENT_FIELDS))])

# Codes, turbine and mast numbers, and default bounds.
FIRST_STATION, LAST_STATION = 2307405, 2307535
TURBINES = 131
MASTS = (38, 39, 246)
STOPPING_TYPES = (0, 1)
MAINTENANCE_CODE = 1005
POWER_LIMIT_CODE = 2006
EXCLUDED_CODE = 50100

MET_BOUNDS = {
    "met_WindSpeedRot": (0.0, 50.0),
    "met_WinddirectionRot": (0.0, 360.0),
    "met_Pressure": (800.0, 1100.0),
    "met_TemperatureTen": (-50.0, 60.0),
}

SANITY_BOUNDS: dict[str, dict[str, tuple[float, float]]] = {
    "grd": {
        "wtc_ActPower_min": (-1000.0, 2600.0),
        "wtc_ActPower_max": (-1000.0, 2600.0),
        "wtc_ActPower_mean": (-1000.0, 2600.0),
    },
    "cnt": {"wtc_kWG1Tot_accum": (-500.0, 500.0), "wtc_kWG1TotE_accum": (0.0, 500.0)},
    "tur": {"wtc_AcWindSp_mean": (0.0, 50.0), "wtc_ActualWindDirection_mean": (0.0, 360.0)},
    "din": {"wtc_PowerRed_timeon": (0.0, 600.0)},
}
