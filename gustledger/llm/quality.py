"""Quality rules: fixed text statistics, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams, one of the trusted documents and one of the whole
collection, are counted over all rows. A document's score is the mean over its n-grams of
``log(p_trusted / p_raw)``: positive when it reads like the trusted ones, whatever its length. Every
document is kept or not by one fixed threshold; nothing is drawn at random.

A null or empty text has no words and a score of 0. Rows repeated exactly score alike. Without
trusted documents the two distributions are equal and all scores are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gustledger.llm import sketch
from gustledger.llm import words as W

#: Cells of the hashed multinomials, the share of the whole collection mixed into the trusted one, and the threshold.
CELLS = 1 << 18
SMOOTHING = 0.05
THRESHOLD = -0.12
_SLICES = 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE_END = np.zeros(256, bool)
_LINE_END[0x0A] = True


def ngram_cells(found: W.Words, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cell and text of every word and word pair, in lower case."""
    pairs, at = W.grams(found, 2)
    both = np.concatenate([found.hashes, W.mix(pairs)])
    return (both >> np.uint64(40)) % np.uint64(cells), np.concatenate([found.text, found.text[at]])


def statistics(block: W.Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a block."""
    texts = len(block)
    found = W.words(block)
    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[block.data])])
    starts, ends = W.ranges(block.data, block.bounds, _LINE_END)
    # Lines with a word, hashed byte by byte; the second and later ones of a text are repeats.
    has = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends = starts[has], ends[has]
    hashes = W.range_hash(W.range_sums(W._CODES[block.data]), starts, ends)
    line_text = np.searchsorted(block.bounds, starts, "right") - 1
    distinct = np.diff(W.per_text(line_text, hashes, texts)[1])
    lines = np.bincount(line_text, minlength=texts)
    grams, at = W.grams(found, 3)
    order = np.lexsort((grams, found.text[at]))
    g, t = grams[order], found.text[at][order]
    same = (g[1:] == g[:-1]) & (t[1:] == t[:-1]) if len(g) else np.zeros(0, bool)
    again = np.zeros(len(g), bool)
    again[1:] |= same
    again[:-1] |= same
    first = at[order][again]
    covered = np.zeros(len(found.hashes), bool)
    for k in range(3):
        covered[first + k] = True
    return {
        "n_words": found.counts(),
        "word_chars": np.bincount(found.text, points[found.ends] - points[found.starts], texts).astype(np.int64),
        "n_symbols": symbols[block.bounds[1:]] - symbols[block.bounds[:-1]],
        "n_dup_lines": lines - distinct,
        "n_repeat_words": np.bincount(found.text, covered, texts).astype(np.int64),
    }


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> np.ndarray:
    """``log(p_trusted / p_raw)`` of every cell. ``trusted`` lists the ids of trusted documents.

    Every document is counted where it is read. Only those that a filter of the trusted ids lets
    through move, to meet the ids; the filter has a fixed number of cells and misses none. The join is
    a merge at every size, since the ids grow with the documents. A partition sends its counts cut
    into slices, and each slice is summed by one task; ``8 * cells`` bytes reach the driver.
    """
    ids = trusted.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    frame = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col).cast("string")).alias("_hash"))
    known = frame.sparkSession.sparkContext.broadcast(
        sketch.members(ids.select(F.xxhash64(F.col("_id").cast("string"))), lambda batch: np.asarray(batch.column(0)).view(np.uint64))
    )

    def perhaps(batches):
        for batch in batches:
            yield batch.filter(pa.array(known.value(np.asarray(batch.column(2)).view(np.uint64))))

    met = frame.mapInArrow(perhaps, frame.schema).join(ids.hint("merge"), F.col("_key") == F.col("_id"), "left_semi")
    # Every document once for the whole collection, and the trusted ones once more.
    frame = frame.select("_text", F.lit(False).alias("_good")).unionByName(met.select("_text", F.lit(True).alias("_good")))
    part = cells // _SLICES

    def counted(batches):
        counts = np.zeros((2, cells), np.int64)
        for batch in batches:
            start = 0
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for block in W.blocks(batch.column(0)):
                cell, text = ngram_cells(W.words(block, W.BLANKS, W.LOWER), cells)
                cell = cell.astype(np.int64)
                trusted_here = good[start : start + len(block)][text]
                counts[0] += np.bincount(cell[trusted_here], minlength=cells)
                counts[1] += np.bincount(cell[~trusted_here], minlength=cells)
                start += len(block)
        if counts.any():
            blobs = [zlib.compress(counts[:, s * part : (s + 1) * part].astype("<i8").tobytes(), 1) for s in range(_SLICES)]
            yield pa.record_batch([pa.array(range(_SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "cells"])

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * part, np.int64)
        for batch in batches:
            for blob in batch.column("cells"):
                total += np.frombuffer(zlib.decompress(blob.as_py()), "<i8")
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=["slice", "cells"])

    total = np.zeros((2, cells))
    schema = "slice int, cells binary"
    for row in frame.mapInArrow(counted, schema).groupBy("slice").applyInArrow(merged, schema).toLocalIterator():
        total[:, row["slice"] * part : (row["slice"] + 1) * part] = np.frombuffer(zlib.decompress(row["cells"]), "<i8").reshape(2, part)
    raw = (total[1] + 1) / (total[1].sum() + cells)
    good = total[0] / total[0].sum() if total[0].sum() else raw
    return np.log((1 - SMOOTHING) * good + SMOOTHING * raw) - np.log(raw)


def rate(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus the text statistics and ``llr``, the mean log-likelihood ratio of its n-grams."""
    new = StructType.fromDDL("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double")
    kept = [c for c in docs.columns if c not in new.names]
    frame, column = docs.select(*kept), kept.index(text_col)
    shared = frame.sparkSession.sparkContext.broadcast(weights)

    def rated(batches):
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {n: [] for n in new.names}
            for block in W.blocks(batch.column(column)):
                for name, values in statistics(block).items():
                    parts[name].append(values)
                cell, text = ngram_cells(W.words(block, W.BLANKS, W.LOWER), len(shared.value))
                size = np.bincount(text, minlength=len(block))
                parts["llr"].append(np.bincount(text, shared.value[cell.astype(np.int64)], len(block)) / np.maximum(size, 1))
            arrays = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64() if n == "llr" else pa.int64()) for n, v in parts.items()]
            yield pa.record_batch([*batch.columns, *arrays], names=[*kept, *new.names])

    return frame.mapInArrow(rated, StructType(frame.schema.fields + new.fields))


def failed():
    """Whether the fixed rules reject a rated document."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
