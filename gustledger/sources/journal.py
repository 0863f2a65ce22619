"""A correction list kept as a stored list and an append-only log of changes.

``<path>/base/version=<n>/rows`` is a list, ``.../folded`` the names of the batches it already
holds; ``<path>/log/batch=<name>`` is one batch of changes.  A writer adds a folder under a name
of its own and touches nothing else, so any number of writers work at once and none undoes
another.  A reader folds the batches its list does not hold into it, in the order of their
names, which start with the writer's clock.  Compaction stores the fold as the next version;
its rows and its batch names appear together, by one renaming.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from gustledger.operators.adjustments import merge_changes
from gustledger.sources.writers import _folders

#: Columns of a change: those of ``upsert_adjustments``, its time, and whether it removes its id.
CHANGE = StructType(
    [
        *[StructField(c, LongType()) for c in ("pos", "id", "alarm_code", "station_nr")],
        *[StructField(c, StringType()) for c in ("time_on", "time_off", "notes")],
        *[StructField(c, BooleanType()) for c in ("set_time_on", "set_time_off", "set_notes", "removed")],
        StructField("last_updated", StringType()),
    ]
)


def _names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    files, make = _folders(spark, folder)
    if not files.exists(make(folder)):
        return []
    found = [f.getPath().getName() for f in files.listStatus(make(folder))]
    return sorted(n.removeprefix(prefix) for n in found if n.startswith(prefix))


def _appear(spark: SparkSession, staged: str, target: str) -> None:
    files, make = _folders(spark, target)
    files.mkdirs(make(target).getParent())
    if files.exists(make(target)) or not files.rename(make(staged), make(target)):
        raise OSError(f"could not put {target} in place")


def _store(spark: SparkSession, path: str, version: int, rows: DataFrame, folded: list[str]) -> None:
    staged = f"{path}/staged-{uuid.uuid4().hex}"
    rows.write.parquet(f"{staged}/rows")
    spark.createDataFrame([(n,) for n in folded], "batch string").coalesce(1).write.parquet(f"{staged}/folded")
    _appear(spark, staged, f"{path}/base/version={version:012d}")


def create(adj: DataFrame, path: str) -> None:
    """Start a journal from a list."""
    _store(adj.sparkSession, path, 0, adj, [])


def _append(rows: DataFrame, path: str) -> str:
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    staged = f"{path}/staged-{name}"
    rows.write.parquet(staged)
    _appear(rows.sparkSession, staged, f"{path}/log/batch={name}")
    return name


def append(changes: DataFrame, path: str, now: str) -> str:
    """Add a batch of changes as ``upsert_adjustments`` takes them; the batch's name is returned.

    ``pos`` orders the changes of the batch.  Half-written batches are never seen.
    """
    rows = changes.withColumns({"removed": F.lit(False), "last_updated": F.lit(now)})
    return _append(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHANGE]), path)


def append_removal(ids: DataFrame, path: str, now: str) -> str:
    """Add a batch that removes every entry of the given ids."""
    given = {"pos": F.lit(0), "id": F.col("id"), "removed": F.lit(True), "last_updated": F.lit(now)}
    rows = ids.select("id").distinct()
    return _append(rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGE]), path)


def fold(adj: DataFrame, log: DataFrame) -> DataFrame:
    """The list after all batches of ``log`` (changes with their ``batch``), in order.

    A removal takes the entries of its id and every earlier change to it.  The log is read by
    aggregates per id; only the places of the batches, one row each, are summed in order.
    """
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = log.groupBy("batch").agg(F.min("pos").alias("_low"), (F.max("pos") - F.min("pos") + 1).alias("_size"))
    places = sizes.select("batch", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_low")).alias("_start"))
    # One row per batch, whose names the reader has listed: the log stays where it is.
    changes = log.join(F.broadcast(places), "batch").withColumn("pos", F.col("pos") + F.col("_start")).drop("_start", "batch")
    gone = changes.where("removed").groupBy("id").agg(F.max("pos").alias("_gone"))
    live = changes.where(~F.col("removed")).join(gone, "id", "left").where(F.col("_gone").isNull() | (F.col("pos") > F.col("_gone")))
    return merge_changes(adj.join(gone, "id", "left_anti").select(*adj.columns), live.drop("_gone"))


def _state(spark: SparkSession, path: str) -> tuple[int, DataFrame, set[str]]:
    versions = _names(spark, f"{path}/base", "version=")
    if not versions:
        raise FileNotFoundError(f"no journal at {path}")
    newest = f"{path}/base/version={versions[-1]}"
    # Batch names that are on file: as many as batches since the last cleaning.
    folded = {r["batch"] for r in spark.read.schema("batch string").parquet(f"{newest}/folded").collect()}
    return int(versions[-1]), spark.read.parquet(f"{newest}/rows"), folded


def _folded(spark: SparkSession, path: str, base: DataFrame, batches: list[str]) -> DataFrame:
    if not batches:
        return base
    log = spark.read.schema(StructType([*CHANGE, StructField("batch", StringType())])).option("basePath", f"{path}/log")
    return fold(base, log.parquet(*[f"{path}/log/batch={b}" for b in batches]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The list with every batch that is there."""
    _, base, folded = _state(spark, path)
    return _folded(spark, path, base, [b for b in _names(spark, f"{path}/log", "batch=") if b not in folded])


def compact(spark: SparkSession, path: str) -> int:
    """Store the list with all batches as the next version; results stay the same.

    Writers and readers may be at work, another compaction may not.  A batch that appears later
    is folded into the new version, also when its name is the older one.
    """
    version, base, folded = _state(spark, path)
    present = _names(spark, f"{path}/log", "batch=")
    _store(spark, path, version + 1, _folded(spark, path, base, [b for b in present if b not in folded]), present)
    return version + 1


def clean(spark: SparkSession, path: str) -> None:
    """Delete batches the newest version holds, older versions and what dead runs have left; nobody may be at work."""
    version, _, folded = _state(spark, path)
    files, make = _folders(spark, path)
    old = [f"{path}/base/version={v}" for v in _names(spark, f"{path}/base", "version=") if int(v) < version]
    used = [f"{path}/log/batch={b}" for b in _names(spark, f"{path}/log", "batch=") if b in folded]
    for folder in [*used, *old, *[f"{path}/staged-{n}" for n in _names(spark, path, "staged-")]]:
        files.delete(make(folder), True)
