"""Direction averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def circular_mean(degrees: Column) -> Column:
    """Aggregate: direction of the summed unit vectors, in [0, 360); 0 when nothing is known."""
    east = F.coalesce(F.sum(F.sin(F.radians(degrees))), F.lit(0.0))
    north = F.coalesce(F.sum(F.cos(F.radians(degrees))), F.lit(0.0))
    return turn(east, north)


def circular_mean_of(columns: list[Column]) -> Column:
    """Row-wise circular mean over several direction columns."""
    zero = F.lit(0.0)
    east, north = zero, zero
    for c in columns:
        east = east + F.coalesce(F.sin(F.radians(c)), zero)
        north = north + F.coalesce(F.cos(F.radians(c)), zero)
    return turn(east, north)


def turn(east: Column, north: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))
