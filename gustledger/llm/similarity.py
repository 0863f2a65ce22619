"""Grouped prefix join: documents whose word-shingle sets have a Jaccard similarity of a threshold or more.

Shingles are ordered from rare to frequent by one sketch of the whole collection (any common order
is right; a good one is fast). Two similar sets must share a token among the first few of each, the
prefix. Steps:

1. Sets: documents with equal sets become one node. Nodes with identical prefix and size become one group.
2. Hubs: inside a group, and inside buckets of equal min-hashes, every node is compared with one
   central node only. Links found so join almost all copies to their class at a cost linear in the
   number of nodes, however many copies a class has.
3. Join: groups that share a prefix token and may be similar by size and position of the token
   are paired, but only if their nodes are not in one class already; pairs are expanded to nodes
   and verified. No pair that could add a link between classes is left out, so the classes are
   those of the complete join.

Verification intersects whole sets of 64-bit shingle hashes.

Defined results: a text of fewer words than a shingle is one shingle of all of them; null and
empty texts have no set and are linked with nothing; rows with one id are one node of the
link graph, with a row each in the result; rows without id are in no class (null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustledger.llm import sketch
from gustledger.llm import words as W
from gustledger.llm.components import components
from gustledger.llm.scratch import Scratch

HUB_KEYS = 4
PARTS = 64


def shingle_sets(block: W.Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, flat, and where each text's begin."""
    found = W.words(block, W.BLANKS, W.LOWER)
    hashes, at = W.grams(found, n)
    text = found.text[at]
    counts = found.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        hashes, text = np.concatenate([hashes, W.whole(found, short)]), np.concatenate([text, short])
    return W.per_text(text, hashes, len(block))


def _needed(n: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Smallest overlap a set of size n needs with any similar set: ceil(t * n)."""
    return -(-n * numerator // denominator)


def signatures(docs: DataFrame, order: sketch.Frequency, n: int, percent: int) -> DataFrame:
    """Per document: set size, 128-bit set fingerprint, prefix in order, hub keys, and how many rare shingles it has."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    schema = "id long, n long, f1 long, f2 long, rare long, prefix array<long>, keys array<long>, parts binary"
    seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, HUB_KEYS, dtype=np.uint64)

    def signed_rows(batches):
        for batch in batches:
            ids, start = batch.column(0), 0
            for block in W.blocks(batch.column(1)):
                sets, first = shingle_sets(block, n)
                size = np.diff(first)
                text = np.repeat(np.arange(len(block)), size)
                counts = shared.value(sets)
                ranked = sets[np.lexsort((sets, counts, text))]
                length = np.where(size > 0, size - _needed(size, percent, 100) + 1, 0)
                rank = np.arange(len(sets)) - first[text]
                keep = rank < length[text]
                has = np.flatnonzero(size)
                at = first[:-1][has]

                def folded(values, how, at=at, has=has, size=size):
                    out = np.zeros(len(size), np.uint64)
                    if len(has):
                        out[has] = how.reduceat(values, at)
                    return out

                prefix = ranked[keep]
                cuts = np.concatenate([[0], np.cumsum(length)])
                keys = [folded(W.mix(sets ^ s), np.minimum) ^ s for s in seeds]
                # Identical prefix and size, as a key.
                sums = W.range_sums(prefix)
                keys.append(W.range_hash(sums, cuts[:-1], cuts[1:]) + size.astype(np.uint64))
                # How many shingles fall into each of PARTS parts of the hash range.
                parts = np.bincount(text * PARTS + (sets >> np.uint64(58)).astype(np.int64), minlength=len(block) * PARTS).astype("<u2" if size.max(initial=0) < 1 << 16 else "<u4")
                width = parts.itemsize * PARTS
                rare = np.bincount(text, counts <= shared.value.ordinary, len(block)).astype(np.int64)
                yield pa.record_batch(
                    [
                        ids.slice(start, len(block)), pa.array(size.astype(np.int64)),
                        pa.array(W.signed(folded(sets, np.add))), pa.array(W.signed(folded(W.mix(sets), np.bitwise_xor))),
                        pa.array(rare), W.lists(W.signed(prefix), cuts),
                        W.lists(W.signed(np.stack(keys, 1).ravel()), np.arange(len(block) + 1) * len(keys)),
                        pa.array([parts.tobytes()[i * width : (i + 1) * width] for i in range(len(block))], pa.binary()),
                    ],
                    names=["id", "n", "f1", "f2", "rare", "prefix", "keys", "parts"],
                )
                start += len(block)

    return docs.mapInArrow(signed_rows, schema)


def _possible(pairs: DataFrame, nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Those pairs whose sets can overlap enough, part by part of the hash range."""
    parts = nodes.select("id", "n", "parts")
    both = pairs.join(parts.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("parts").alias("parts_a")), "a")
    both = both.join(parts.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("parts").alias("parts_b")), "b")

    def counts(column):
        return [np.frombuffer(x.as_buffer(), "<u2" if len(x.as_buffer()) == 2 * PARTS else "<u4") for x in column]

    def possible(batches):
        for batch in batches:
            if len(batch):
                room = np.array([int(np.minimum(x, y).sum(dtype=np.int64)) for x, y in zip(counts(batch.column("parts_a")), counts(batch.column("parts_b")), strict=True)])
                sizes = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
                yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * room >= percent * sizes))

    return scratch.store(both.select("a", "b", "n_a", "n_b", "parts_a", "parts_b").mapInArrow(possible, "a long, b long"))


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """Those pairs ``a, b`` of nodes whose sets are similar enough. Only sets of nodes in pairs are moved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = sketch.repeated(ids, lambda batch: iter([np.repeat(W.mix(np.asarray(batch.column(0)).view(np.uint64)), 2)]), 1 << 23, 2)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets_of(batches):
        for batch in batches:
            keep = shared.value(W.mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            batch = batch.filter(pa.array(keep))
            start = 0
            for block in W.blocks(batch.column(1)):
                sets, first = shingle_sets(block, n)
                data = W.signed(sets).astype("<i8")
                yield pa.record_batch([batch.column(0).slice(start, len(block)), pa.array([data[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["id", "shingles"])
                start += len(block)

    sets = scratch.store(docs.mapInArrow(sets_of, "id long, shingles binary").join(ids, "id", "left_semi"))
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<i8"), np.frombuffer(y.as_buffer(), "<i8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scratch.store(joined.select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long"))


def _hub_pairs(nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Every node with the most central node of each of its buckets: the one with the fewest rare shingles."""
    keyed = nodes.select("id", "n", "rare", F.posexplode("keys").alias("which", "key"))
    hubs = scratch.store(keyed.groupBy("which", "key").agg(F.min(F.struct("rare", "id", "n")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members"))
    close = keyed.join(hubs, ["which", "key"]).where(F.col("id") != F.col("hub.id")).where(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    return close.select(F.greatest("id", "hub.id").alias("a"), F.least("id", "hub.id").alias("b")).distinct()


def _prefix_pairs(nodes: DataFrame, classes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs of nodes of different classes that share a prefix token and may be similar.

    Tokens that occur in one node only are sorted out by a sketch. Per token, the nodes of one class
    with equal size and position count as one entry, so a class of many copies is paired with others
    once and never with itself.
    """
    tokens = sketch.repeated(nodes.select("prefix"), lambda batch: iter([np.asarray(batch.column(0).flatten()).view(np.uint64)]), 1 << 26, 3)
    shared = nodes.sparkSession.sparkContext.broadcast(tokens)

    def listed(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            flat = np.asarray(prefix.flatten()).view(np.uint64)
            size = np.asarray(prefix.value_lengths(), np.int64)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            keep = shared.value(flat)
            row, pos, flat = row[keep], pos[keep], flat[keep]
            yield pa.record_batch([batch.column("id").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(pos), pa.array(W.signed(flat))], names=["id", "n", "pos", "token"])

    postings = nodes.select("id", "n", "prefix").mapInArrow(listed, "id long, n long, pos long, token long")
    postings = scratch.store(postings.join(classes, postings["id"] == classes["node"], "left").select("id", "n", "pos", "token", F.coalesce("component", "id").alias("class")))
    entries = postings.groupBy("token", "class", "n", "pos").agg(F.count(F.lit(1)).alias("nodes"))
    mixed = entries.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("token")
    entries = scratch.store(entries.join(mixed, "token", "left_semi").drop("nodes"))
    left = entries.select("token", *[F.col(c).alias(f"{c}_a") for c in ("class", "n", "pos")])
    right = entries.select("token", *[F.col(c).alias(f"{c}_b") for c in ("class", "n", "pos")])
    # Overlap at least t / (1 + t) * (n_a + n_b); at the first token that a pair shares, at most that one and what follows it in both.
    room = 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * room >= percent * (F.col("n_a") + F.col("n_b")))
    met = scratch.store(left.join(right, "token").where(F.col("class_a") < F.col("class_b")).where(fits))
    side = postings.select("token", "class", "n", "pos", "id")
    a = side.select("token", *[F.col(c).alias(f"{c}_a") for c in ("class", "n", "pos")], F.col("id").alias("a"))
    b = side.select("token", *[F.col(c).alias(f"{c}_b") for c in ("class", "n", "pos")], F.col("id").alias("b"))
    pairs = met.join(a, ["token", "class_a", "n_a", "pos_a"]).join(b, ["token", "class_b", "n_b", "pos_b"])
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar_documents(docs: DataFrame, scratch: Scratch, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component``: a row per document, with the smallest id its class of similar documents reaches."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def counted(batch):
        for block in W.blocks(batch.column(1)):
            yield shingle_sets(block, n)[0]

    order = sketch.frequency(texts, counted)
    signed = scratch.store(signatures(texts, order, n, percent))
    full = signed.where("n > 0 AND id IS NOT NULL")
    nodes = full.groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "rare", "prefix", "keys", "parts")).alias("s")).select("f1", "f2", "n", "s.*")
    nodes = scratch.store(nodes)
    own = texts.where("id IS NOT NULL")
    hub_links = _verified(_possible(_hub_pairs(nodes, scratch, percent), nodes, scratch, percent), own, scratch, n, percent)
    # A document with several rows links the nodes of all its texts; the smallest id of a set stands for it.
    members = scratch.store(full.select("id", "f1", "f2", "n").join(nodes.select("f1", "f2", "n", F.col("id").alias("node")), ["f1", "f2", "n"]).select("id", "node"))
    same = members.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    links = hub_links.unionByName(same)
    classes = scratch.store(components(links, scratch))
    more = _verified(_possible(_prefix_pairs(nodes, classes, scratch, percent), nodes, scratch, percent), own, scratch, n, percent)
    if not more.isEmpty():
        classes = scratch.store(components(links.unionByName(more), scratch))
    named = signed.select("id", "n").join(classes, signed["id"] == classes["node"], "left")
    return named.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def keep_one(docs: DataFrame, scratch: Scratch, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which no similar one has a smaller id. Rows without id stay."""
    classes = similar_documents(docs, scratch, n, percent, id_col, text_col)
    gone = scratch.result(classes.where("component <> id").select(F.col("id").alias(id_col)).distinct())
    return docs.join(gone, id_col, "left_anti")
