"""Helpers shared by the operators: inputs, row keys, scratch tables.

Row identity. Rows that agree in ``doc_id`` and in their whole text are one
document: they share the key (doc_id, xxhash64(text)) and get the same result.
A null ``doc_id`` sorts after every other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import checkpoint_root

#: A word of the corpus contracts: a run without ASCII white space.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of one Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other scripts)."""
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns that clash with an operator's own output names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts can be long, workers have little memory.

    Session settings that only size batches; results do not depend on them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the session's JVM ends."""
    path = f"{checkpoint_root(spark)}/sieveline-{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
