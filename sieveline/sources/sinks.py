"""Storage of logs and vectors as Parquet tables (K1-K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.schema import LOG_COLUMNS, LOG_SCHEMA
from sieveline.sources.snapshots import log_table


def latest_per_id(df: DataFrame, order_col: str = "ingested_at") -> DataFrame:
    """One row per id, the newest by ``order_col``."""
    # Rows of the same time and id: the rest of the row decides, so that every run keeps the same one.
    rest = F.xxhash64(*[F.to_json(c) if t.startswith(("map", "struct", "array<struct")) else F.col(c)
                        for c, t in df.dtypes if c not in ("id", order_col)])
    w = Window.partitionBy("id").orderBy(F.col(order_col).desc(), rest)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def upsert(existing: DataFrame, new: DataFrame, order_col: str = "ingested_at") -> DataFrame:
    """K1/K2 insert-or-replace by id: existing rows whose id is not in the
    new batch (anti join), plus the newest new row per id."""
    fresh = latest_per_id(new, order_col)
    return existing.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*existing.columns))


def upsert_logs(existing: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(existing.select(*LOG_COLUMNS), new.select(*LOG_COLUMNS))


def upsert_embeddings(existing: DataFrame, new: DataFrame, order_col: str = "timestamp") -> DataFrame:
    """K2: same rule for (id, embedding, document, metadata ...) rows."""
    return upsert(existing, new, order_col)


def delete_logs(logs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """K3: logs minus the given ids (anti join)."""
    return logs.join(ids.select(F.col(id_col).cast("string").alias("id")), "id", "left_anti")


def deleted_count(logs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """K3: how many stored rows a delete removes (semi join count)."""
    return logs.join(ids.select(F.col(id_col).cast("string").alias("id")), "id", "left_semi") \
               .agg(F.count(F.lit(1)).alias("deleted"))


def write_logs(logs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1 sink: a versioned table of Parquet partitioned by ``event_date`` (see ``snapshots``); overwrite replaces
    only the partitions present in ``logs``, append adds to them."""
    log_table(logs.sparkSession, path).write(logs, replace=mode == "overwrite")


def upsert_stored(spark: SparkSession, new: DataFrame, path: str) -> None:
    """K1 on a stored table: insert or replace by id. Only the days on which replaced rows lie are rewritten; the
    same batch twice changes nothing."""
    log_table(spark, path).upsert(new)


def delete_stored(spark: SparkSession, ids: DataFrame | None, path: str, id_col: str = "id") -> int:
    """K3 on a stored table: delete by id (None: all rows); returns how many rows went (0: none found)."""
    table = log_table(spark, path)
    return table.delete(ids, id_col) if table.exists() else 0


def read_logs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """K5: stored logs with the fixed schema (metadata stays a map); a plain Parquet folder of them works too."""
    table = log_table(spark, path)
    if version is None and not table.version().parts and not table.numbers():
        return spark.read.schema(LOG_SCHEMA).parquet(path)
    return table.read(version)
