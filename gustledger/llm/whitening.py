"""Whitening of embeddings by Chebyshev-filtered subspace iteration over distributed passes.

The leading eigenvectors of the covariance are found without forming it: a pass over the vectors
multiplies a thin block Q by the centred ``X'XQ / n``, each task for its rows, and Spark adds the
products up. A Chebyshev polynomial of the covariance, run as a three-term recurrence of such
passes, keeps what lies between 0 and the block's smallest Ritz value below one and lets the wanted
end of the spectrum grow; QR and Rayleigh-Ritz then turn the block to the best eigenvector
estimates. This repeats until the residual ``|VQ - Qe|`` of every wanted pair, measured by a pass of
its own and not estimated, is below ``TOLERANCE`` of the largest eigenvalue.

Entries become whole numbers first. Centring takes the floor of the mean off exactly and then its
fraction, so that large means cost no digits. Null vectors and those with null or non-finite
entries are left out, and so are vectors of another length than most have (ties: the longer).
Repeated rows each count and each get their rows. Without vectors the result is empty. Where the
vectors span fewer dimensions than there are components, the components without variance have
``whitened`` null and ``explained`` 0, as with one vector or equal ones. Equal eigenvalues have any
orthonormal basis of their space. A component's largest entry is positive. Only the id and the vector
are read, so other columns may have any name; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gustledger.llm import vectors
from gustledger.llm.scratch import Scratch

#: Columns in the block beyond the wanted ones, degree of the filter, largest residual, most filter cycles, and the
#: most by which the filter may lift one wanted direction over another.
GUARD = 24
DEGREE = 10
TOLERANCE = 2e-13
CYCLES = 100
SPREAD = 1e8
#: An eigenvalue below this share of the largest counts as none.
NO_VARIANCE = 1e-12


@dataclass
class Whitening:
    """Fit of a table: row count, exact sums, floor and fraction of the mean, components (columns) and their variances."""

    count: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float
    passes: int
    residual: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.count, self.sums)

    def scaled(self) -> np.ndarray:
        """Components over the root of their variance; NaN where there is none."""
        return self.components / np.sqrt(np.where(self.variances > 0, self.variances, np.nan))


def centred(x: np.ndarray, count: int, sums: list[int]) -> np.ndarray:
    floor = np.array([s // count for s in sums], np.int64)
    fraction = np.array([(s % count) / count for s in sums])
    return (x - floor).astype(float) - fraction


def filtered(multiply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, product: np.ndarray, degree: int, edge: float, top: float) -> np.ndarray:
    """Chebyshev polynomial of the covariance times ``block``: at most 1 on [0, edge] against its value at ``top``.

    ``product`` is the covariance times ``block``. The recurrence is scaled by the polynomial's value at
    ``top``, so nothing overflows.
    """
    half = edge / 2
    first = sigma = half / (top - half)
    before, now = block, (product - half * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, 2 * following / half * (multiply(now) - half * now) - sigma * following * before
        sigma = following
    return now


def leading(multiply: Callable[[np.ndarray], np.ndarray], length: int, wanted: int, guard: int = GUARD, degree: int = DEGREE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues, their eigenvectors (columns) and the largest certified residual.

    A block as wide as the space needs no filter. Certified leading pairs are locked: the filter runs
    on what is orthogonal to them. Its degree is held down while the largest eigenvalue left would
    outgrow the last wanted one by more than ``SPREAD``, which would cost the latter its digits. If the
    residual isn't reached an error is raised.
    """
    width = min(length, wanted + guard)
    block = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((length, width)))[0]
    for _ in range(CYCLES):
        product = multiply(block)
        values, turn = np.linalg.eigh((block.T @ product + product.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        top = values[0]
        residual = np.linalg.norm(product[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0)
        done = residual <= tolerance * top
        if top <= 0 or done.all():
            return values[:wanted], block[:, :wanted], float(residual.max(initial=0.0) / top) if top > 0 else 0.0
        locked = int(done.argmin())
        held, active = block[:, :locked], slice(locked, None)
        # Without variance beyond the block any small edge will do.
        edge = max(values[-1], NO_VARIANCE * top)
        reach = np.arccosh(np.maximum(2 * values[[locked, wanted - 1]] / edge - 1, 1))
        steps = int(np.clip(np.log(SPREAD) / max(reach[0] - reach[1], 1e-9), 1, degree))

        def apart(q: np.ndarray, held: np.ndarray = held) -> np.ndarray:
            return q - held @ (held.T @ q)

        grown = filtered(lambda q, apart=apart: apart(multiply(q)), block[:, active], apart(product[:, active]), steps, edge, max(values[locked], 2 * edge))
        # Ordered by eigenvalue: columns that grow least give way to those that grow most.
        block = np.linalg.qr(np.hstack([held, grown]))[0]
    raise ArithmeticError(f"no certified components after {CYCLES} cycles; residual {residual.max() / top:.1e}")


def usual_length(df: DataFrame, vector_col: str) -> int | None:
    """The length most finite vectors have; of equally frequent ones the larger."""
    lengths = df.where(vectors.finite(vector_col)).groupBy(F.size(vector_col).alias("n")).count()
    row = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else None


def fit(df: DataFrame, scratch: Scratch, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """Learn the whitening of all usable vectors; None where there are none.

    The vectors are stored once in packed form, and every pass reads that table. A pass sends
    ``length * block width`` numbers from each task to Spark's sum and as many to the driver.
    """
    length = usual_length(df, vector_col)
    if not length:
        return None
    rows = scratch.store(vectors.packed(df, id_col, vector_col, length, scale, shift).select("vector"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length + 1, np.int64)
        for batch in batches:
            x = vectors.matrix(batch.column(0), length)
            total[0] += len(x)
            total[1:] += x.sum(0, dtype=np.int64)
        yield pa.record_batch([pa.array(range(length + 1), pa.int32()), pa.array(total)], names=["cell", "value"])

    exact = vectors.cells_summed(rows.mapInArrow(added, "cell int, value long"))
    count, sums = exact[0], [exact[i + 1] for i in range(length)]
    passes = 0

    def over_rows(function: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sum over all rows of ``size`` numbers that a centred piece of rows gives."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                total += function(centred(vectors.matrix(batch.column(0), length), count, sums)).ravel()
            yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(total)], names=["cell", "value"])

        done = rows.mapInArrow(part, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        result = np.zeros(size)
        result[np.asarray(done["cell"])] = np.asarray(done["value"])
        return result

    def multiply(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return over_rows(lambda x: x.T @ (x @ block), block.size).reshape(block.shape) / count

    trace = float(over_rows(lambda x: np.array([(x * x).sum()]), 1)[0]) / count
    values, found, residual = leading(multiply, length, min(components, length))
    largest = found[np.abs(found).argmax(0), np.arange(found.shape[1])]
    values = np.where(values > NO_VARIANCE * max(values[0], 0), values, 0.0)
    return Whitening(count, sums, values, found * np.sign(largest), trace, passes, residual)


def deviations(x: np.ndarray, count: int, sums: list[int]) -> pa.Array:
    """``sum((count * x - sums)**2)`` of every row, exactly, as decimal(38,0)."""
    if not len(x) or not x.shape[1]:
        return pa.array([Decimal(0)] * len(x), pa.decimal128(38, 0))
    bound = count * int(np.abs(x).max()) + max(abs(s) for s in sums)
    if bound >= 1 << 55:
        apart = x.astype(object) * count - np.array(sums, object)
        return pa.array([Decimal(int(v)) for v in (apart * apart).sum(1)], pa.decimal128(38, 0))
    apart = x.astype(np.int64) * count - np.array(sums, np.int64)
    largest = int(np.abs(apart).max())
    if largest * largest * x.shape[1] < 1 << 62:
        return pa.array((apart * apart).sum(1)).cast(pa.decimal128(38, 0))
    # In halves of 28 bits; 64 products of halves fit in 64 bits.
    high, low = apart >> 28, apart & ((1 << 28) - 1)
    total = [0] * len(x)
    for start in range(0, x.shape[1], 64):
        h, l = high[:, start : start + 64], low[:, start : start + 64]  # noqa: E741
        squares, products, rest = (h * h).sum(1).tolist(), (h * l).sum(1).tolist(), (l * l).sum(1).tolist()
        total = [t + (a << 56) + (b << 29) + c for t, a, b, c in zip(total, squares, products, rest, strict=True)]
    return pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))


def transform(df: DataFrame, model: Whitening, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id``, ``deviation`` (exact) and ``whitened`` (one number per component) of every usable vector."""
    length, scaled = len(model.sums), model.scaled()
    rows = vectors.packed(df, id_col, vector_col, length, scale, shift)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column(1), length)
            y = model.centred(x) @ scaled
            flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * y.shape[1]), flat)
            yield pa.record_batch([batch.column(0), deviations(x, model.count, model.sums), lists], names=["id", "deviation", "whitened"])

    schema = StructType([rows.schema["id"], *StructType.fromDDL("deviation decimal(38,0), whitened array<double>").fields])
    return rows.mapInArrow(whiten, schema)


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened vectors minus the identity, over components with variance."""
    use = np.flatnonzero(model.variances > 0)
    size = len(model.variances)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            y = np.nan_to_num(batch.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)
            total[0] += y.sum(0)
            total[1:] += y.T @ y
        yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    done = whitened.select("whitened").mapInArrow(part, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((size + 1) * size)
    for r in done:
        total[r["cell"]] = r["value"]
    total = total.reshape(size + 1, size) / model.count
    # The whitened mean is zero but for rounding; its square is taken off all the same.
    error = np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(size))[np.ix_(use, use)]
    return float(error.max(initial=0.0))
