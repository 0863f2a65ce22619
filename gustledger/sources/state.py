"""Change state of stored and source tables: fingerprints that merge, kept by file and by month.

A fingerprint is the row count with the sum and the exclusive-or of two row hashes. The hashes see
which columns are NULL and where a value stands, so a value that moves to another column counts as
a change. The sum does not cancel where rows repeat, as the exclusive-or does. All five numbers add up over parts of
a table in any order: a month's fingerprint is that of its files taken together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEEDS = (1, 2)
FILE = ["file", "size", "modified"]
_SUMS, _XORS = [f"sum_{s}" for s in SEEDS], [f"xor_{s}" for s in SEEDS]


def row_mark(columns: list[str], seed: int) -> Column:
    """64-bit hash of a row. Spark's hash passes over NULLs, so every value comes with its null flag."""
    values = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *[part for v in values for part in (v.isNull(), v)])


def _checksum(sums: list[Column], xors: list[Column]) -> Column:
    parts = [F.coalesce(F.sum(s), F.lit(0)).cast("decimal(38,0)").alias(n) for n, s in zip(_SUMS, sums, strict=True)]
    parts += [F.coalesce(F.bit_xor(x), F.lit(0)).alias(n) for n, x in zip(_XORS, xors, strict=True)]
    return F.struct(*parts).alias("checksum")


def state_checksum(df: DataFrame, columns: list[str], by=()) -> DataFrame:
    """Row count and an order-free fingerprint, to detect changed rows."""
    marked = df.select(*by, *[row_mark(columns, s).alias(f"_mark_{s}") for s in SEEDS])
    marks = [F.col(f"_mark_{s}") for s in SEEDS]
    # Nineteen digits a row leave room for 10^19 rows.
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), _checksum([m.cast("decimal(28,0)") for m in marks], marks))


def merge_states(states: DataFrame, by=()) -> DataFrame:
    """The state of tables put together from the states of their parts."""
    return states.groupBy(*by).agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        _checksum([F.col(f"checksum.{n}") for n in _SUMS], [F.col(f"checksum.{n}") for n in _XORS]),
    )


def changed_periods(source_state: DataFrame, stored_state: DataFrame, by: list[str]) -> DataFrame:
    """Compare two states: unchanged, changed, or not stored yet."""
    stored = stored_state.select(*by, F.col("row_count").alias("stored_count"), F.col("checksum").alias("stored_checksum"))
    same = (F.col("row_count") == F.col("stored_count")) & (F.col("checksum") == F.col("stored_checksum"))
    return (
        source_state.join(stored, by, "left")
        .withColumn(
            "status",
            F.when(F.col("stored_count").isNull(), "METADATA_MISSING")
            .when(same, "NO_CHANGE")
            .otherwise("CHANGE_DETECTED"),
        )
        .select(*by, "row_count", "stored_count", "status")
    )


def latest_state(metadata: DataFrame, by=("table", "period")) -> DataFrame:
    """The last written state of every table and month."""
    values = [c for c in metadata.columns if c not in by]
    return (
        metadata.groupBy(*by)
        .agg(F.max_by(F.struct(*values), "last_updated").alias("state"))
        .select(*by, "state.*")
    )


def file_listing(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Files below a folder with size and time of change; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_states(
    spark: SparkSession,
    path: str,
    columns: list[str],
    known: DataFrame | None = None,
    by=("period",),
    pattern: str = "*.parquet",
    read: Callable[[list[str]], DataFrame] | None = None,
) -> DataFrame:
    """One state per file and ``by``; only files not in ``known`` with the same size and time are read.

    ``known`` is an earlier result. Files that are gone drop out of it. Paths of the files to read
    pass through the driver, which lists the folder anyway; rows never do.
    """
    listing = file_listing(spark, path, pattern)
    fresh = listing if known is None else listing.join(known.select(*FILE), FILE, "left_anti")
    paths = [r["file"] for r in fresh.select("file").collect()]
    kept = None if known is None else known.join(listing, FILE, "left_semi")
    if not paths and kept is not None:
        return kept
    rows = read(paths) if read else spark.read.option("basePath", path).parquet(*paths)
    place = F.col("_metadata")
    located = rows.withColumns(dict(zip(FILE, (place["file_path"], place["file_size"], place["file_modification_time"]), strict=True)))
    states = state_checksum(located, columns, [*FILE, *by])
    return states if kept is None else kept.unionByName(states)


def month_manifest(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """The months of a stored table with their files and bytes, from names and sizes of files alone.

    A month is the value of a ``period=`` folder, or the first ``YYYY-MM`` of a file's own name.
    """
    file = F.col("file")
    folder, name = F.regexp_extract(file, r"/period=(\d{4}-\d{2})/", 1), F.regexp_extract(file, r"/(\d{4}-\d{2})[^/]*$", 1)
    months = file_listing(spark, path, pattern).withColumn("period", F.coalesce(F.nullif(folder, F.lit("")), F.nullif(name, F.lit(""))))
    return months.where(F.col("period").isNotNull()).groupBy("period").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
