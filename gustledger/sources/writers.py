"""Writers.  Months are folders; rewriting one month leaves the others in place."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gustledger.functions.numbers import decimal_comma, narrow_floats


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is executed inside removes its shuffle files at its end, and not when the driver next collects its garbage."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)


def write_partitioned(df: DataFrame, path: str, by: str = "period", form: str = "parquet", rebalance: bool = True) -> None:
    """Replace the months present in ``df``.

    The rebalance hint lets adaptive execution split a big month over several
    files and merge small ones, so no month has to pass through one task. It moves all rows once
    more: without it each task writes what it has of each month, for rows that are dealt evenly already.
    """
    rows = df.hint("rebalance", by) if rebalance else df
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if form == "parquet":
        writer = writer.option("compression", "zstd")
    if form == "csv":
        writer = writer.option("header", True)
    with shuffles_removed(df.sparkSession):
        writer.partitionBy(by).format(form).save(path)


def _folders(spark: SparkSession, path: str):
    """Hadoop's file system of a path and a function that makes paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def exists(spark: SparkSession, path: str) -> bool:
    files, make = _folders(spark, path)
    return files.exists(make(path))


def stage(df: DataFrame, path: str, by: str = "period") -> str:
    """Write the months of ``df`` beside ``path``, where no reader looks; the folder's name is returned."""
    beside = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    write_partitioned(df, beside, by)
    return beside


def publish(spark: SparkSession, staged: str, path: str) -> list[str]:
    """Put every staged month in the place of the stored one, by renaming folders.

    A month is first set aside, then replaced, then deleted. If a run dies in between,
    :func:`recover` puts back what was set aside. Other months stay. Returns the month folders.
    """
    files, make = _folders(spark, path)
    aside = f"{path.rstrip('/')}.aside-{uuid.uuid4().hex}"
    months = sorted(f.getPath().getName() for f in files.listStatus(make(staged)) if f.isDirectory())
    for folder in (path, aside):
        files.mkdirs(make(folder))
    for month in months:
        if files.exists(make(f"{path}/{month}")) and not files.rename(make(f"{path}/{month}"), make(f"{aside}/{month}")):
            raise OSError(f"could not set {path}/{month} aside")
        if not files.rename(make(f"{staged}/{month}"), make(f"{path}/{month}")):
            raise OSError(f"could not publish {path}/{month}")
    for folder in (aside, staged):
        files.delete(make(folder), True)
    return months


def recover(spark: SparkSession, path: str) -> list[str]:
    """Undo what a run that died has left beside ``path``: months set aside and not replaced return.

    Only one run may write a table at a time. Returns the month folders that were put back.
    """
    files, make = _folders(spark, path)
    parent, name, back = make(path).getParent(), make(path).getName(), []
    left = [f.getPath() for f in files.listStatus(parent)] if files.exists(parent) else []
    for folder in left:
        if folder.getName().startswith(f"{name}.aside-"):
            for month in files.listStatus(folder):
                target = make(f"{path}/{month.getPath().getName()}")
                if not files.exists(target):
                    if not files.rename(month.getPath(), target):
                        raise OSError(f"could not put {target} back")
                    back.append(target.getName())
        if folder.getName().startswith((f"{name}.aside-", f"{name}.staged-")):
            files.delete(folder, True)
    return sorted(back)


def write_results(results: DataFrame, path: str, rebalance: bool = True) -> None:
    """Store rounded results by month, numbers as 4-byte floats."""
    write_partitioned(narrow_floats(results), path, rebalance=rebalance)


def append_state(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("append").parquet(path)


def write_grouped(numbered: DataFrame, path: str) -> None:
    """Monthly table as text with a decimal comma, under a column of row numbers; other months stay."""
    write_partitioned(decimal_comma(numbered), path, form="csv")


def write_report(issues: DataFrame, summary: DataFrame, path: str) -> None:
    """Issues and their summary as two JSON folders; months that the report does not cover stay."""
    for part, name in ((issues, "issues"), (summary, "summary")):
        if "period" in part.columns:
            write_partitioned(part, f"{path}/{name}", form="json")
        else:
            part.write.mode("overwrite").json(f"{path}/{name}")
