"""Count-min sketches of 64-bit values: one per partition, merged slice by slice.

Cells only ever overestimate, so what a sketch calls single is single. The number of cells is a
parameter; with many more values than cells the sketch sorts out less, but never wrongly.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gustledger.llm.words import mix

SLICES = 64
_SCHEMA = "slice int, cells binary"


def _row(slice_no, blob) -> pa.RecordBatch:
    return pa.record_batch([pa.array(slice_no, pa.int32()), pa.array(blob, pa.binary())], names=["slice", "cells"])


def rows_of(values: np.ndarray, width: int, rows: int) -> Iterator[np.ndarray]:
    """Cell of every value in each row of the sketch."""
    for r in range(rows):
        yield (mix(values ^ np.uint64((r * 0xD1B54A32D192ED03) & (2**64 - 1))) >> np.uint64(20)) & np.uint64(width - 1)


class Repeated:
    """Tells which values may have been counted twice or more. ``bits``: one bit per cell and row."""

    def __init__(self, bits: np.ndarray, width: int, rows: int):
        self.bits, self.width, self.rows = bits, width, rows

    def __call__(self, values: np.ndarray) -> np.ndarray:
        seen = np.ones(len(values), bool)
        for r, cell in enumerate(rows_of(values, self.width, self.rows)):
            seen &= (self.bits[r, cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return seen


def repeated(df: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int = 1 << 26, rows: int = 2) -> Repeated:
    """Sketch of which values occur twice or more. ``values`` gives the values of a batch, each counted once.

    A partition sends the cells it touched, cut by slice; each slice is summed by one task. Only
    two bits a cell would matter, so counts stop at two; what reaches the driver is ``width * rows / 8`` bytes.
    """
    part = width // SLICES

    def touched(batches):
        for batch in batches:
            found = [v for v in values(batch)]
            if not found:
                continue
            found = np.concatenate(found)
            for r, cell in enumerate(rows_of(found, width, rows)):
                cell = np.sort(cell.astype(np.uint32))
                cuts = np.searchsorted(cell, np.arange(SLICES + 1, dtype=np.uint64) * part)
                yield _row([r * SLICES + s for s in range(SLICES)], [np.diff(cell[a:b], prepend=np.uint32(s * part)).astype("<u4").tobytes() for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(part, np.uint8)
        for batch in batches:
            for blob in batch.column("cells"):
                cell, n = np.unique(np.cumsum(np.frombuffer(blob.as_buffer(), "<u4"), dtype=np.uint32), return_counts=True)
                counts[cell % part] = np.minimum(counts[cell % part] + np.minimum(n, 2), 2)
        yield _row([key[0].as_py()], [zlib.compress(np.packbits(counts >= 2, bitorder="little").tobytes(), 1)])

    bits = np.zeros((rows, width // 8), np.uint8)
    for row in df.mapInArrow(touched, _SCHEMA).groupBy("slice").applyInArrow(merged, _SCHEMA).toLocalIterator():
        r, s = divmod(row["slice"], SLICES)
        bits[r, s * part // 8 : (s + 1) * part // 8] = np.frombuffer(zlib.decompress(row["cells"]), np.uint8)
    return Repeated(bits, width, rows)


def members(df: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], width: int = 1 << 25, rows: int = 2) -> Repeated:
    """Tells which values may be among those of ``df``; none that is among them is missed."""
    return repeated(df, lambda batch: iter([np.repeat(values(batch), 2)]), width, rows)


class Frequency:
    """Estimated count of a value, and whether it stands out from a mean cell."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        mean = counts.mean(dtype=np.float64)
        self.ordinary = mean + 3 * np.sqrt(mean) + 1

    def __call__(self, values: np.ndarray) -> np.ndarray:
        (cell,) = rows_of(values, len(self.counts), 1)
        return self.counts[cell]


def frequency(df: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int = 1 << 22) -> Frequency:
    """Counts from a one-row sketch."""
    part = width // SLICES

    def counted(batches):
        cells = np.zeros(width, np.uint32)
        for batch in batches:
            for v in values(batch):
                (cell,) = rows_of(v, width, 1)
                np.add.at(cells, cell, 1)
        if cells.any():
            yield _row(list(range(SLICES)), [zlib.compress(cells[s * part : (s + 1) * part].astype("<u4").tobytes(), 1) for s in range(SLICES)])

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part, np.uint64)
        for batch in batches:
            for blob in batch.column("cells"):
                total += np.frombuffer(zlib.decompress(blob.as_py()), "<u4")
        yield _row([key[0].as_py()], [zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)])

    total = np.zeros(width, np.uint32)
    for row in df.mapInArrow(counted, _SCHEMA).groupBy("slice").applyInArrow(merged, _SCHEMA).toLocalIterator():
        total[row["slice"] * part : (row["slice"] + 1) * part] = np.frombuffer(zlib.decompress(row["cells"]), "<u4")
    return Frequency(total)
