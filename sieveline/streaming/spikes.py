"""T5/D2 in the stream: z-scores of event counts, kept as running moments per key.

Two stateful steps. A watermarked window aggregate counts the logs of each key
and bucket; counts are partly summed before the shuffle, so a key with a third
of all logs costs one row per task and bucket. When the watermark passes a
bucket it is closed and its count, one row, goes on to the second step, which
keeps for each key how many buckets were closed and the sums of their counts
and squared counts, and scores the bucket against them. Spikes so leave the
stream as buckets close; late logs within the watermark are counted, later
ones belong to the stored table only.

``running_zscores`` is the batch form of the same scores. A bucket's score
against the whole history, as ``anomalies.bucket_zscores`` has it, follows from
the stream's output by ``settled_zscores``: the newest moments of a key are
those of all its closed buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOMENTS = "n_buckets long, total long, squares double"
SCORED = f"key string, bucket timestamp, count long, {MOMENTS}"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Moments(StatefulProcessor):
    """Number, sum and sum of squares of a key's closed bucket counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", MOMENTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd
        # Closed buckets of one key in one batch: few rows.
        closed = pd.concat(list(rows)).sort_values("bucket")
        n, total, squares = self.moments.get() if self.moments.exists() else (0, 0, 0.0)
        out = []
        for bucket, count in zip(closed["bucket"], closed["count"], strict=True):
            n, total, squares = n + 1, total + int(count), squares + float(count) ** 2
            out.append((key[0], bucket, int(count), n, total, squares))
        self.moments.update((n, total, squares))
        yield pd.DataFrame(out, columns=["key", "bucket", "count", "n_buckets", "total", "squares"])

    def close(self) -> None:
        pass


def zscore(count: Column, n: Column, total: Column, squares: Column) -> Column:
    """z-score by the moments (population std), null where all counts are equal."""
    mean = total / n
    # n * squares - total^2 is a whole number: exactly 0 where all counts are equal.
    spread = n * squares - total.cast("double") * total
    return F.when(spread > 0, (count - mean) / (F.sqrt(spread) / n))


def _scored(df: DataFrame) -> DataFrame:
    c = F.col
    return (df.withColumn("mean", c("total") / c("n_buckets"))
            .withColumn("zscore", zscore(c("count"), c("n_buckets"), c("total"), c("squares"))))


def spike_stream(logs: DataFrame, by: str = "source", minutes: int = 10, watermark: str = "10 minutes") -> DataFrame:
    """(key, bucket, count, n_buckets, total, squares, mean, zscore) of every bucket as it closes."""
    counts = (logs.withWatermark("timestamp", watermark)
              .groupBy(F.window("timestamp", f"{minutes} minutes").alias("w"), F.coalesce(F.col(by), F.lit("")).alias("key"))
              .agg(F.count(F.lit(1)).alias("count"))
              .select("key", F.col("w.start").alias("bucket"), "count"))
    return _scored(counts.groupBy("key").transformWithStateInPandas(
        Moments(), outputStructType=SCORED, outputMode="Append", timeMode="None"))


def is_spike(z_threshold: float = 2.0, min_buckets: int = 3) -> Column:
    """D2's rule on scored buckets."""
    return (F.col("n_buckets") >= min_buckets) & (F.col("zscore") > z_threshold)


def run_spikes(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a ``spike_stream`` that writes to a Parquet folder (default: all that is there, then stop)."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)  # read when the query starts; keyed state needs it
    try:
        return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
                .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def running_zscores(logs: DataFrame, by: str = "source", minutes: int = 10) -> DataFrame:
    """The batch form: each bucket against its key's buckets up to it."""
    from sieveline.operators.anomalies import bucket_counts
    w = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = bucket_counts(logs.withColumn(by, F.coalesce(F.col(by), F.lit(""))), by, minutes)
    square = F.col("count").cast("double") * F.col("count")
    return _scored(counts.select("key", "bucket", "count", F.count(F.lit(1)).over(w).alias("n_buckets"),
                                 F.sum("count").over(w).alias("total"), F.sum(square).over(w).alias("squares")))


def settled_zscores(scored: DataFrame) -> DataFrame:
    """Each bucket of a stream's output against all closed buckets of its key."""
    newest = scored.groupBy(F.col("key").alias("_k")).agg(
        F.max_by(F.struct("n_buckets", "total", "squares"), "n_buckets").alias("_m"))
    return _scored(scored.select("key", "bucket", "count").join(newest, F.col("key") == F.col("_k"))
                   .select("key", "bucket", "count", "_m.*"))
