"""Intermediate tables in the folder that all executors share, removed after use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gustledger.plans.settle import shared_folder


class Scratch:
    """A folder of Parquet tables for one operator call.

    ``store`` writes a frame once, so that a lost executor costs a re-read and not a recomputation,
    and so that Spark knows the size of what it joins next. Leaving the ``with`` block removes the
    folder; ``result`` first saves the outcome as a checkpoint, whose files Spark itself looks after.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.tables = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def store(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        return df.checkpoint()
