"""Centroid clustering over zone maps: blocks of a space-filling curve skip the centroids that cannot win.

Vectors become whole numbers, are ordered along a Hilbert curve and cut into blocks; a block keeps
the smallest and largest value of every component (its box). In each round a block first asks which
centroids can be nearest to any point of its box. Against the centroid nearest to the middle of the
box, another one is out when even the point of the box that favours it most is not nearer to it:
the difference of two squared distances is linear, so its largest value over a box is exact and
costs one product per component. The vectors of the block are then compared exactly with the
centroids left. Everything is in whole numbers, so results depend on neither order nor layout.

Null vectors, vectors of another length and those with null or non-finite entries are left out.
Rows repeated exactly each count and each get a row; equal distances go to the smaller centroid
number. With fewer vectors than centroids every vector starts one; without vectors the result is
empty. Only the id and the vector are read, so other columns may have any name. Rows without id are
clustered like others and start a centroid only when nothing else is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from gustledger.llm import vectors
from gustledger.llm.scratch import Scratch

#: Vectors in a block; axes of the curve, those that vary most, and bits of each (a key has to fit in 63 bits).
BLOCK = 256
AXES = 21
BITS = 3
#: Below this size of a component, sums of products are exact in double precision.
_EXACT = 1 << 22


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates, each of ``bits`` bits.

    Level by level from the coarsest: where the bit of an axis is set, the finer bits of the first
    axis are reflected, otherwise exchanged with those of the axis. A Gray code of the bits of all
    axes then numbers the cells along the curve.
    """
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        finer = np.uint64((1 << level) - 1)
        for i in range(len(x)):
            is_set = ((x[i] >> np.uint64(level)) & one).astype(bool)
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[i]) & finer)
            x[0] = x[0] ^ np.where(is_set, finer, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= ((x[-1] >> np.uint64(level)) & one) * np.uint64((1 << level) - 1)
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | (((axis ^ turn) >> np.uint64(level)) & one)
    return key


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For every box (row) and centroid: whether some point of the box may have it as its nearest.

    Ties go to the smaller number, so a centroid that can only tie with a smaller one is out too.
    """
    middle = low + high  # twice the middle
    to_middle = ((middle[:, None, :] - 2 * centroids[None, :, :]) ** 2).sum(2)
    pivot = to_middle.argmin(1)
    size = (centroids**2).sum(1)
    # distance to the pivot minus distance to another: size difference + 2 * (other - pivot) * point
    slope = 2 * (centroids[None, :, :] - centroids[pivot][:, None, :])
    most = np.maximum(slope * low[:, None, :], slope * high[:, None, :]).sum(2) + size[pivot][:, None] - size[None, :]
    number = np.arange(len(centroids))
    return (most > 0) | ((most == 0) & (number[None, :] < pivot[:, None])) | (number[None, :] == pivot[:, None])


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid (ties: the smaller) and the squared distance, exactly."""
    kind = np.float64 if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    distance = (c * c).sum(1)[None, :] - 2 * (p @ c.T)
    best = distance.argmin(1)
    return best, (distance[np.arange(len(p)), best] + (p * p).sum(1)).astype(np.int64)


@dataclass
class Zones:
    """Blocks of Hilbert-ordered vectors: ``ids, vectors, low, high`` in a stored table."""

    blocks: DataFrame
    length: int
    count: int

    def scan(self, centroids: np.ndarray) -> Iterator:
        """A function for Arrow batches of blocks: ids, points, cluster and distance of one block after the other."""
        length = self.length

        def scanned(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                boxes = [vectors.matrix(batch.column(name), length).astype(np.int64) for name in ("low", "high")]
                may_win = candidates(*boxes, centroids)
                for row in range(batch.num_rows):
                    points = np.frombuffer(batch.column("vectors")[row].as_buffer(), "<i4").reshape(-1, length)
                    left = np.flatnonzero(may_win[row])
                    best, distance = nearest(points, centroids[left])
                    yield batch.column("ids")[row].values, points, left[best], distance

        return scanned


def zones(df: DataFrame, scratch: Scratch, length: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, axes: int = AXES, bits: int = BITS) -> Zones:
    """Lay the usable vectors out in blocks along a Hilbert curve.

    The packed vectors are stored before they move, so that their place in the curve is fixed. Very
    many equal vectors share a key; the row's place in its file splits them over several ranges.
    """
    rows = scratch.store(vectors.packed(df, id_col, vector_col, length, scale))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = 0, None, None
        total, squares = np.zeros(length, np.int64), np.zeros(length)
        for batch in batches:
            x = vectors.matrix(batch.column(0), length).astype(np.int64)
            if len(x):
                count += len(x)
                total += x.sum(0)
                squares += (x.astype(float) ** 2).sum(0)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if count:
            yield pa.record_batch([pa.array(range(length), pa.int32()), pa.array([count] * length), pa.array(total.astype(float)), pa.array(squares), pa.array(low), pa.array(high)], names=["axis", "n", "s", "q", "low", "high"])

    seen = rows.select("vector").mapInArrow(spread, "axis int, n long, s double, q double, low long, high long")
    seen = seen.groupBy("axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high"))
    facts = sorted(seen.collect())  # one row per component
    if not facts:
        return Zones(rows, length, 0)
    facts.sort(key=lambda r: (-(r["q"] - r["s"] ** 2 / r["n"]), r["axis"]))
    used = np.array([r["axis"] for r in facts[:axes]])
    floor, width = np.array([r["low"] for r in facts[:axes]]), np.array([r["high"] - r["low"] + 1 for r in facts[:axes]])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column(1), length)[:, used].astype(np.int64)
            key = hilbert(((x - floor) << bits) // width, bits).astype(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(key)], names=[*batch.schema.names, "key"])

    schema = StructType(rows.schema.fields + StructType.fromDDL("key long").fields)
    ordered = rows.mapInArrow(keyed, schema).repartitionByRange("key", F.xxhash64("place", "vector")).sortWithinPartitions("key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column(1), length)
            starts = np.arange(0, len(x), block)
            pieces = [x[s : s + block] for s in starts]
            ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)), pa.int32()), batch.column(0))
            bounds = [pa.array([f(p, axis=0).astype("<i4").tobytes() for p in pieces], pa.binary()) for f in (np.min, np.max)]
            yield pa.record_batch([ids, pa.array([p.tobytes() for p in pieces], pa.binary()), *bounds], names=["ids", "vectors", "low", "high"])

    schema = StructType([StructField("ids", ArrayType(rows.schema["id"].dataType)), *StructType.fromDDL("vectors binary, low binary, high binary").fields])
    return Zones(scratch.store(ordered.select("id", "vector").mapInArrow(cut, schema)), length, facts[0]["n"])


def starting_centroids(df: DataFrame, k: int, seed: str, length: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """The ``k`` usable vectors whose id, as ``seed:id``, has the smallest SHA-256; equal ids go by their components."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(scale * v))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    kept = df.where(vectors.finite(vector_col) & (F.size(vector_col) == length)).select(order.alias("_order"), x.alias("_x"))
    first = kept.orderBy(F.asc_nulls_last("_order"), "_x").limit(k).collect()
    return np.array([r["_x"] for r in first], np.int64).reshape(-1, length)


def cluster(
    df: DataFrame, scratch: Scratch, k: int, rounds: int, length: int, scale: int, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` of every usable vector after ``rounds`` rounds, and the final centroids.

    A centroid becomes the floor of its vectors' mean, component by component; one without vectors
    stays. Each task sums what it has assigned, ``k * (length + 1)`` numbers, whatever its size; these
    are added up by Spark and reach the driver as that many numbers.
    """
    centroids = starting_centroids(df, k, seed, length, scale, id_col, vector_col)
    zoned = zones(df, scratch, length, scale, id_col, vector_col, block)
    schema = StructType([StructField("id", df.schema[id_col].dataType), *StructType.fromDDL("cluster int, distance long").fields])
    if not zoned.count:
        return df.sparkSession.createDataFrame([], schema), centroids
    width = length + 1
    for _ in range(rounds):
        scan, size = zoned.scan(centroids), len(centroids)

        def summed(batches: Iterator[pa.RecordBatch], scan=scan, size=size) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, width), np.int64)
            for _, points, best, _ in scan(batches):
                for c in np.unique(best):
                    own = points[best == c]
                    total[c, 0] += len(own)
                    total[c, 1:] += own.sum(0, dtype=np.int64)
            cells = np.flatnonzero(total)
            yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(total.ravel()[cells])], names=["cell", "value"])

        sums = vectors.cells_summed(zoned.blocks.select("ids", "vectors", "low", "high").mapInArrow(summed, "cell int, value long"))
        moved = centroids.copy()
        for c in range(size):
            if count := sums.get(c * width, 0):
                moved[c] = [sums.get(c * width + 1 + i, 0) // count for i in range(length)]
        centroids = moved
    scan = zoned.scan(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, best, distance in scan(batches):
            yield pa.record_batch([ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return scratch.store(zoned.blocks.mapInArrow(assigned, schema)), centroids


def inertia(assigned: DataFrame) -> dict[int, int]:
    """Sum of the distances in every cluster that has vectors."""
    total = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    return {r["cluster"]: int(r["s"]) for r in total.collect()}
