"""Removal of word sequences that an earlier document already has.

A window is ``n`` consecutive words. A first pass sketches, per partition, how often windows may
occur; the merged sketch only overestimates. A second pass takes the windows that may be repeated,
groups them exactly by a 128-bit fingerprint, and finds the smallest document id of each.

The sketch counts a window by its anchor, the smallest hash among the runs of ``GRAM`` words in it.
Equal windows have equal anchors, so the count of the anchor in documents is at least the
window's, and neighbouring windows share an anchor: the sketch holds a twentieth of the values.

A word goes if any window over it also starts in a document with a smaller id. Windows are judged
on the input. Null and empty texts have no words. Rows of one id do not affect each other; rows
without id neither lose words nor make others lose any.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gustledger.llm import sketch
from gustledger.llm import words as W
from gustledger.llm.scratch import Scratch

GRAM = 8


def window_hashes(found: W.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and anchor of every window, and the index of its first word."""
    gram = min(GRAM, n)
    hashes, at = W.grams(found, n)
    if not len(at):
        return hashes, hashes, at
    sums = W.range_sums(found.hashes)
    start = np.arange(len(found.hashes) - gram + 1)
    least = W.range_hash(sums, start, start + gram)
    # Smallest of n - gram + 1 neighbours, by doubling; windows never cross texts, so neither do these.
    width = 1
    while 2 * width <= n - gram + 1:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = n - gram + 1 - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return hashes, least[at], at


def _anchors(column: int, n: int):
    def values(batch):
        for block in W.blocks(batch.column(column)):
            found = W.words(block)
            _, anchor, at = window_hashes(found, n)
            yield W.per_text(found.text[at], anchor, len(block))[0]

    return values


def repeated_windows(docs: DataFrame, scratch: Scratch, n: int, cells: int = 1 << 26) -> DataFrame:
    """``id, row, at``: windows of ``docs`` (id, row, text) that also start in a document with a smaller id, by first word."""
    texts = docs.where("id IS NOT NULL")
    maybe = texts.sparkSession.sparkContext.broadcast(sketch.repeated(texts, _anchors(2, n), cells))

    def candidates(batches):
        for batch in batches:
            start = 0
            for block in W.blocks(batch.column(2)):
                found = W.words(block)
                hashes, anchor, at = window_hashes(found, n)
                keep = maybe.value(anchor)
                hashes, anchor, at = hashes[keep], anchor[keep], at[keep]
                text = found.text[at]
                rows = pa.array(start + text)
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - found.first[text]).cast(pa.int32()), pa.array(W.signed(hashes)), pa.array(W.signed(anchor))], names=["id", "row", "at", "w1", "w2"])
                start += len(block)

    windows = scratch.store(texts.mapInArrow(candidates, "id long, row long, at int, w1 long, w2 long"))
    first = windows.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("w1", "w2", "least")
    first = scratch.store(first)
    # Most candidates are single after all: those that a filter of the repeated ones rules out do not move again.
    fingerprint = lambda batch: W.mix(batch.column(0).to_numpy().view(np.uint64)) ^ batch.column(1).to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(sketch.members(first.select("w1", "w2"), fingerprint))

    def among(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value(fingerprint(batch))))

    again = windows.select("w1", "w2", "id", "row", "at")
    again = again.mapInArrow(among, again.schema)
    return again.join(first, ["w1", "w2"]).where("id > least").select("id", "row", "at")


def remove_repeated(docs: DataFrame, scratch: Scratch, n: int = 50, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept") -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``n_removed`` and ``kept``, the remaining words joined by one space."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    gone = repeated_windows(keyed, scratch, n).groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.array_sort(F.collect_set("at")).alias("_at"))
    gone = scratch.store(gone)
    new = StructType.fromDDL(f"n_words long, n_removed long, `{kept_col}` string")
    kept = [c for c in docs.columns if c not in new.names]
    source = [] if text_col in kept else [F.col(text_col).alias("_text")]
    width = len(kept) + len(source)
    where = len(kept) if source else kept.index(text_col)
    frame = docs.select(*kept, *source, F.col(id_col).cast("long").alias("_key"), F.xxhash64(id_col, text_col).alias("_hash"))
    # Only texts that may lose words move to meet their places; a filter of their keys lets none of them slip.
    key = lambda i, row: W.mix(W.mix(np.asarray(i).view(np.uint64)) ^ np.asarray(row).view(np.uint64))
    losers = docs.sparkSession.sparkContext.broadcast(sketch.repeated(gone.select("_id", "_row"), lambda batch: iter([np.repeat(key(batch.column(0), batch.column(1)), 2)]), 1 << 25))

    def among(batches, wanted):
        for batch in batches:
            ids, hashes = batch.column(width), batch.column(width + 1)
            keep = losers.value(key(ids.fill_null(0), hashes)) & np.asarray(ids.is_valid())
            yield batch.filter(pa.array(keep == wanted))

    def cut(batches, placed):
        for batch in batches:
            start = 0
            for block in W.blocks(batch.column(where)):
                found = W.words(block)
                data = block.data.tobytes()
                counts, removed, left = [], [], []
                for i in range(len(block)):
                    low, high = int(found.first[i]), int(found.first[i + 1])
                    stay = np.ones(high - low, bool)
                    at = batch.column(width)[start + i].values if placed else None
                    if at is not None and len(at):
                        at = np.asarray(at)
                        change = np.bincount(at, minlength=high - low + 1) - np.bincount(np.minimum(at + n, high - low), minlength=high - low + 1)
                        stay = np.cumsum(change)[: high - low] == 0
                    which = low + np.flatnonzero(stay)
                    counts.append(high - low)
                    removed.append(high - low - len(which))
                    left.append(b" ".join([data[a:b] for a, b in zip(found.starts[which].tolist(), found.ends[which].tolist(), strict=True)]))
                columns = [batch.column(c).slice(start, len(block)) for c in range(len(kept))]
                yield pa.record_batch([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], names=[*kept, *new.names])
                start += len(block)

    schema = StructType(docs.select(*kept).schema.fields + new.fields)
    moved = frame.mapInArrow(lambda batches: among(batches, True), frame.schema)
    touched = moved.join(gone, (F.col("_key") == F.col("_id")) & (F.col("_hash") == F.col("_row")), "left").select(*frame.columns[:width], "_at")
    # Filter and cut of the other texts share a Python worker.
    rest = frame.mapInArrow(lambda batches: cut(among(batches, False), False), schema)
    return touched.mapInArrow(lambda batches: cut(batches, True), schema).unionByName(rest)
