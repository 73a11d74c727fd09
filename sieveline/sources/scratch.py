"""Intermediate tables in the shared folder (cut lineage without caching in executors)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sieveline.session import checkpoint_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the session's JVM ends."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: what uses it repeatedly does not plan its source again, and a lost
    executor costs nothing that was written."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
