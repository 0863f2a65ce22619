"""Bring a source extract and the stored copy of a month together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_columns(first: DataFrame, second: DataFrame) -> list[str]:
    """Columns of the stored copy in their order, then those only the other side has."""
    return [*second.columns, *[c for c in first.columns if c not in second.columns]]


def reconcile(source: DataFrame, existing: DataFrame, keys: list[str], mode: str = "append") -> DataFrame:
    """Rows of both sides by key, with ``_change``: ``new``, ``kept`` or ``common``.

    The source wins where both have a row; rows gone from the source are kept. Columns keep the
    type of the stored copy, so that later months have one schema.
    ``mode="force-overwrite"`` takes the source as it is.
    """
    if mode == "force-overwrite":
        return source.withColumn("_change", F.lit("new"))
    columns = align_columns(source, existing)
    left = source.select(*keys, F.struct(*[c for c in source.columns if c not in keys], F.lit(1).alias("_is")).alias("_source"))
    right = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys], F.lit(1).alias("_is")).alias("_stored"))

    def value(c: str):
        if c in keys:
            return F.col(c)
        new = F.col(f"_source.`{c}`") if c in source.columns else F.lit(None)
        if c in existing.columns:
            new = new.cast(existing.schema[c].dataType)
        old = F.col(f"_stored.`{c}`") if c in existing.columns else F.lit(None)
        return F.when(F.col("_source").isNotNull(), new).otherwise(old).alias(c)

    change = (
        F.when(F.col("_stored").isNull(), "new").when(F.col("_source").isNull(), "kept").otherwise("common")
    )
    return left.join(right, keys, "full_outer").select(*[value(c) for c in columns], change.alias("_change"))
