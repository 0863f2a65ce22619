"""Sets of grid stamps as bitmaps: which steps of a range have rows.

A bitmap is one aggregate of a few kilobytes per group, whatever the number of rows, and merges by
OR: of few groups each task hands on one bitmap instead of the stamps it has seen. Many groups are
brought together first, as a bitmap is larger than a group's rows in a task. Step ``i`` of a range
is bit ``i % 8`` of byte ``i / 8``.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from gustledger.functions import timegrid as tg

#: Bits of one bitmap aggregate, and the longest range: a calendar month.
BITS = 4096 * 8
LONGEST = timedelta(days=31)


def step_number(ts: Column, start: Column, step: timedelta) -> Column:
    """Number of the step of a grid stamp, counted from the start of its range."""
    return F.call_function("div", tg.epoch_micros(ts) - tg.epoch_micros(start), F.lit(tg.to_micros(step)))


def steps_seen(number: Column, step: timedelta) -> Column:
    """Aggregate: bitmap of the step numbers, NULL ones left out."""
    bitmaps = -(-LONGEST // step) // BITS + 1
    beyond = F.raise_error(F.lit("a range is longer than a month"))
    safe = F.when(number < bitmaps * BITS, number).when(number.isNotNull(), beyond.cast("long"))
    parts = []
    for b in range(bitmaps):
        place = F.when((safe >= b * BITS) & (safe < (b + 1) * BITS), safe - b * BITS) if bitmaps > 1 else safe
        parts.append(F.bitmap_construct_agg(place))
    return F.concat(*parts) if bitmaps > 1 else parts[0]


def byte_at(bits: Column, at: Column) -> Column:
    """A byte of a bitmap as a number."""
    return F.conv(F.hex(F.substring(bits, at.cast("int") + 1, F.lit(1))), 16, 10).cast("int")


def has_step(bits: Column, number: Column) -> Column:
    return F.getbit(byte_at(bits, F.call_function("div", number, F.lit(8))), (number % 8).cast("int")) == 1


def steps_counted(bits: Column) -> Column:
    return F.bitmap_count(bits)


def steps_absent(bits: Column, expected: Column) -> Column:
    """Array of the step numbers below ``expected`` that are not in the bitmap, in order; all of them without a bitmap.

    Full bytes are passed over, so that a nearly complete range costs little more than its gaps.
    """
    last = F.call_function("div", expected - 1, F.lit(8))
    open_bytes = F.filter(F.sequence(F.lit(0).cast("long"), last), lambda j: F.substring(bits, j.cast("int") + 1, F.lit(1)) != F.lit(b"\xff"))

    def zeros(j: Column) -> Column:
        value = byte_at(bits, j)
        return F.filter(F.sequence(j * 8, F.least(j * 8 + 7, expected - 1)), lambda i: F.getbit(value, (i % 8).cast("int")) == 0)

    none = F.array().cast("array<bigint>")
    everything = F.sequence(F.lit(0).cast("long"), expected - 1)
    return F.when(expected <= 0, none).when(bits.isNull(), everything).otherwise(F.flatten(F.transform(open_bytes, zeros)))
