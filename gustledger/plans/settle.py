"""Durable cut points inside a long plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from gustledger.sources.writers import shuffles_removed


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only for a local session without a setting."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="gustledger-"))
    return configured or context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder once, for a frame that is read several times.

    They are stored as Parquet: each reader takes its columns only, and Spark knows the size of what it joins next.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
