"""Embedding vectors as rows of whole numbers, packed for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Entries of this size or more are refused with an error: sums and squares of whole numbers would no longer fit in 64 bits.
TOO_LARGE = float(1 << 20)


def finite(vector_col: str = "embedding") -> Column:
    """Whether a vector is there and holds neither nulls nor non-finite entries."""
    return F.coalesce(F.forall(F.col(vector_col).cast("array<double>"), lambda x: F.abs(x) < F.lit(float("inf"))), F.lit(False))


def packed(df: DataFrame, id_col: str, vector_col: str, length: int, scale: int, shift: int = 0) -> DataFrame:
    """``id``, ``vector`` and ``place`` of every finite vector with ``length`` entries.

    ``vector`` holds ``floor(scale * entry) + shift`` as little-endian 32-bit numbers, ``place`` is
    the row's number in its task. Other columns are not carried, whatever their names.
    """
    frame = df.where(finite(vector_col) & (F.size(vector_col) == length)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = StructType([frame.schema["id"], *StructType.fromDDL("vector binary, place long").fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            n = batch.num_rows
            x = np.asarray(batch.column(1).flatten()).reshape(n, length)
            if n and np.abs(x).max(initial=0) >= TOO_LARGE:
                raise ValueError(f"{vector_col} has an entry of {TOO_LARGE:.0f} or more")
            x = (np.floor(scale * x) + shift).astype("<i4")
            cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * length), n, [None, pa.py_buffer(x.tobytes())]) if length else pa.array([b""] * n)
            yield pa.record_batch([batch.column(0), cells.cast(pa.binary()), pa.array(np.arange(seen, seen + n))], names=["id", "vector", "place"])
            seen += n

    return frame.mapInArrow(pack, schema)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of a packed column."""
    _, offsets, data = column.buffers()
    width = 8 if pa.types.is_large_binary(column.type) else 4
    ends = np.frombuffer(offsets, np.int64 if width == 8 else np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or not length:
        return np.zeros((len(column), length), np.int32)
    return np.frombuffer(data, "<i4", (ends[-1] - ends[0]) // 4, ends[0]).reshape(len(column), length)


def cells_summed(partial: DataFrame) -> dict[int, int]:
    """Exact sums of ``value`` by ``cell``, from the few cells that every task yields."""
    total = partial.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return {r["cell"]: int(r["value"]) for r in total.collect()}
