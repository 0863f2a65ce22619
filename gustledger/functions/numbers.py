"""Rounding and report formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame, skip=()) -> list[str]:
    return [n for n, kind in df.dtypes if n not in skip and (kind in NUMERIC or kind.startswith("decimal"))]


def half_even(column: Column, digits: int = 2) -> Column:
    """Round a double on its scaled value, ties to the even digit.

    Plain double arithmetic, far cheaper than ``round``, which goes through decimals.
    """
    scale = float(10**digits)
    return F.rint(column * scale) / scale


def round_numeric(df: DataFrame, digits: int = 2, skip=("StationId",)) -> DataFrame:
    """Round every floating-point column."""
    return df.select(
        *[
            half_even(F.col(f"`{n}`"), digits).alias(n) if kind in ("double", "float") and n not in skip else F.col(f"`{n}`")
            for n, kind in df.dtypes
        ]
    )


def narrow_floats(df: DataFrame, skip=("StationId",)) -> DataFrame:
    """Store doubles as 4-byte floats (used on write, after rounding)."""
    return df.select(
        *[
            F.col(f"`{n}`").cast("float").alias(n) if kind == "double" and n not in skip else F.col(f"`{n}`")
            for n, kind in df.dtypes
        ]
    )


def format_numbers(df: DataFrame, digits: int = 2, skip=()) -> DataFrame:
    """Numbers as text with thousands separators."""
    wanted = set(numeric_columns(df, skip))
    return df.select(
        *[F.format_number(F.col(f"`{n}`"), digits).alias(n) if n in wanted else F.col(f"`{n}`") for n in df.columns]
    )


def plain_digits(column: Column) -> Column:
    """Shortest text of a number without an exponent, with one decimal at least. Beyond 20 digits on either side the exponent stays."""
    text = column.cast("string")
    spread = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(text.contains("E"), F.coalesce(spread, text)).otherwise(text)


def decimal_comma(df: DataFrame, skip=()) -> DataFrame:
    """Floating-point columns as text with a decimal comma."""
    return df.select(
        *[
            F.translate(plain_digits(F.col(f"`{n}`")), ".", ",").alias(n)
            if kind in ("double", "float") and n not in skip
            else F.col(f"`{n}`")
            for n, kind in df.dtypes
        ]
    )
