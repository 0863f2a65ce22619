"""Shards of bounded size by extendible hashing.

A shard is a bucket of documents whose hashes begin with the same bits. The directory starts with
one bucket, and only buckets over the byte limit split, on the next bit, until all fit. Sizes are
counted for BITS bits at a time, bottom up, so a directory of any depth takes a pass per BITS bits and
only over the documents of buckets that still do not fit.

A document larger than the limit is a shard of its own. The hash covers id and text. Rows repeated
exactly share it; when they alone exceed the limit they are parted by a hash of their row number.
Null and empty texts have no bytes and go where their hash says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustledger.llm.scratch import Scratch

BITS = 16
#: Bits of the hash, and of the row number's hash behind it.
WIDTH = 64


def _bits(rows: DataFrame, done: int) -> DataFrame:
    """``cell``: the next BITS bits of the hash after ``done`` bits, or of the row number's hash after the first 64."""
    source = "hash" if done < WIDTH else "spare"
    return rows.withColumn("cell", F.shiftrightunsigned(F.shiftleft(F.col(source), done % WIDTH), WIDTH - BITS))


def shards(docs: DataFrame, scratch: Scratch, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, bytes, shard, shard_bytes``: the shard is named by its leading bits (empty for a single bucket)."""
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("spare"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.lit("").alias("prefix"),
    )
    open_rows = scratch.store(sized)
    placed = None
    for done in range(0, 2 * WIDTH, BITS):
        rows = _bits(open_rows, done)
        cells = scratch.store(rows.groupBy("prefix", "cell").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
        path = cells.select("prefix", "cell", "bytes", "n", F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("depth"))
        path = path.withColumn("node", F.substring(F.lpad(F.conv(F.col("cell").cast("string"), 10, 2), BITS, "0"), F.lit(1), F.col("depth")))
        nodes = path.groupBy("prefix", "node").agg(F.sum("bytes").alias("node_bytes"), F.sum("n").alias("node_n"))
        nodes = scratch.store(nodes.withColumn("over", (F.col("node_bytes") > limit) & (F.col("node_n") > 1)))
        up = nodes.where("over").select("prefix", F.col("node").alias("parent"))
        head = F.col("node") == ""
        below = nodes.where(~head).withColumn("parent", F.expr("substring(node, 1, length(node) - 1)")).join(up, ["prefix", "parent"], "left_semi").drop("parent")
        # Leaves: under a bucket that split, and fitting; at the last bit, whatever is left.
        leaves = nodes.where(head).select(*below.columns).unionByName(below).where(~F.col("over") | (F.length("node") == BITS))
        own = path.select("prefix", "cell", "node").join(leaves, ["prefix", "node"])
        own = scratch.store(own.select("prefix", "cell", F.concat("prefix", "node").alias("shard"), F.col("node_bytes").alias("shard_bytes"), "over"))
        named = scratch.store(rows.join(own, ["prefix", "cell"]))
        final = named if done + BITS >= 2 * WIDTH else named.where(~F.col("over"))
        final = final.select("id", "bytes", "shard", "shard_bytes")
        placed = final if placed is None else placed.unionByName(final)
        open_rows = named.where("over").select("id", "hash", "spare", "bytes", F.col("shard").alias("prefix"))
        if open_rows.isEmpty():
            break
    return placed


def directory(placed: DataFrame) -> DataFrame:
    """One row per shard: its leading bits, depth, documents and bytes."""
    return placed.groupBy("shard").agg(F.length("shard").alias("depth"), F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"))


def write(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` (one row per id) as Parquet, a folder per shard."""
    docs.join(placed.select(F.col("id").alias(id_col), "shard"), id_col).repartition("shard").write.partitionBy("shard").parquet(path)
