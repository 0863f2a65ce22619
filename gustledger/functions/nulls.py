"""Null rules shared by every operator.

Signals arrive with missing values as NULL or NaN.  Inside the library only NULL
is used, a comparison with a missing value counts as false, and a division by
zero gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_true(condition: Column) -> Column:
    """The condition, with an unknown outcome counted as false."""
    return F.coalesce(condition, F.lit(False))


def differs(column: Column, value) -> Column:
    """``column <> value`` where a missing value counts as different."""
    return column.isNull() | (column != value)


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def clip_zero(column: Column) -> Column:
    """Negative values become zero; missing values stay missing."""
    return F.when(column < 0, F.lit(0.0)).otherwise(column)


def share(part: Column, other: Column, amount: Column) -> Column:
    """``amount`` in proportion to ``part / (part + other)``; zero when both are zero."""
    return or_zero(F.try_divide(part, part + other) * amount)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column."""
    return df.select(
        *[
            F.nanvl(F.col(f"`{name}`"), F.lit(None).cast(kind)).alias(name)
            if kind in ("double", "float")
            else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def row_hash(columns: list[str]) -> Column:
    """md5 of the concatenated text of the columns, missing values as empty text."""
    return F.md5(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
