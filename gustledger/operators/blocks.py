"""Ordered scans over keys of any size.

A window over one station keeps all rows of that station in one task.  The log of
one station can be a large part of all alarms, so the scans here cut a key into
time blocks: a small aggregate per block gives what earlier (or later) blocks
contribute, and the window itself only runs inside a block.  The aggregate is
combined before its shuffle and has one row per key and block, so the window over
it is bounded by the covered time divided by the block width.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg

BLOCK = "_block"


def running_max_before(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    out: str,
    width: timedelta = tg.ONE_HOUR,
) -> DataFrame:
    """Add the largest ``value`` among earlier rows of the key; NULL on its first row.

    ``order`` starts with the time column that defines the blocks.
    """
    rows = df.withColumn(BLOCK, tg.slot(F.col(order[0]), width))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, BLOCK)
        .agg(F.max(value).alias("_top"))
        .select(*keys, BLOCK, F.max("_top").over(earlier).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(carry, [*keys, BLOCK])
        .withColumn(out, F.greatest(F.max(value).over(inside), F.col("_carry")))
        .drop(BLOCK, "_carry")
    )


def last_before(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    picks: dict[str, Column],
    width: timedelta = tg.ONE_HOUR,
) -> DataFrame:
    """Add for every pick its last known value among earlier rows of the key.

    A backward as-of join once two kinds of rows are put together: a pick is NULL on
    rows of the other kind.  ``order`` starts with the time that defines the blocks.
    """
    rows = df.withColumns({BLOCK: tg.slot(F.col(order[0]), width), **{f"_pick_{n}": c for n, c in picks.items()}})
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    ends = rows.groupBy(*keys, BLOCK).agg(
        *[F.max_by(f"_pick_{n}", F.when(F.col(f"_pick_{n}").isNotNull(), place)).alias(n) for n in picks]
    )
    carry = ends.select(*keys, BLOCK, *[F.last(n, ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in picks])
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = {
        n: F.coalesce(F.last(f"_pick_{n}", ignorenulls=True).over(inside), F.col(f"_carry_{n}")) for n in picks
    }
    return (
        rows.join(carry, [*keys, BLOCK])
        .withColumns(found)
        .drop(BLOCK, *[f"_pick_{n}" for n in picks], *[f"_carry_{n}" for n in picks])
    )


def first_at_or_after(
    asks: DataFrame,
    ask_time: Column,
    facts: DataFrame,
    fact_time: str,
    keys: list[str],
    out: str,
    width: timedelta = timedelta(hours=4),
) -> DataFrame:
    """Add to every row of ``asks`` the earliest fact time of its key at or after ``ask_time``, else NULL.

    A forward as-of join through a zone map: per key and block the sorted array of its distinct
    fact times.  Facts are read and shuffled once, combined before; what moves afterwards are the
    arrays.  An ask goes to its block and is answered inside the array, or by the first fact of a
    later block.  Asks without a key or a time get NULL.
    """
    known = [*keys, BLOCK]
    questions = asks.withColumn("_at", ask_time).withColumn(BLOCK, tg.slot(F.col("_at"), width))
    made = facts.select(*keys, tg.slot(F.col(fact_time), width).alias(BLOCK), F.col(fact_time).alias("_made"))
    # Blocks that are asked for and hold no fact take part with an empty array.
    asked = questions.select(*known, F.lit(None).cast(made.schema["_made"].dataType).alias("_made"))
    later = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    zones = (
        made.unionByName(asked)
        .groupBy(*known)
        .agg(F.array_sort(F.collect_set("_made")).alias("_times"))
        .withColumn("_carry", F.min(F.get("_times", F.lit(0))).over(later))
    )
    inside = F.array_min(F.filter("_times", lambda t: t >= F.col("_at")))
    return questions.join(zones, known, "left").select(*asks.columns, F.coalesce(inside, F.col("_carry")).alias(out))
