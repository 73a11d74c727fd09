"""Structured Streaming jobs.

The same DataFrame operators run on streams: a text file stream is parsed
per micro-batch (format detection needs whole files, which arrive whole in
one batch), logs are fanned out to severity subscriptions by a stream-static
join, and hourly counts are kept with a watermark.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import FEED_PREVIEW, iso_timestamp, preview
from sieveline.schema import SEVERITIES

FEED_COLUMNS = ["id", "timestamp", "source", "hostname", "severity", "message", "log_type"]


def feed_view(logs: DataFrame) -> DataFrame:
    """The seven feed fields, the JSON message, and the 120-char preview."""
    payload = F.to_json(F.struct(F.lit("log").alias("type"), F.struct(
        "id", iso_timestamp(F.col("timestamp")).alias("timestamp"), "source", "hostname", "severity", "message",
        "log_type").alias("data")))
    return logs.select(*FEED_COLUMNS, payload.alias("payload"),
                       preview(F.col("message"), FEED_PREVIEW).alias("preview"))


def subscriptions_table(spark: SparkSession, subs: dict[str, list[str] | None]) -> DataFrame:
    """Subscriber -> severities (None = all five), exploded to one row each."""
    rows = [(k, list(v) if v else list(SEVERITIES)) for k, v in subs.items()]
    return spark.createDataFrame(rows, "subscriber string, severities array<string>") \
                .select("subscriber", F.explode("severities").alias("severity"))


def fan_out(logs: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each log once per subscriber whose set holds its severity.
    ``subscriptions`` is (subscriber, severity): at most five rows per
    subscriber, joined by severity (stream-static or batch), broadcast if
    they are few enough."""
    from sieveline.operators.joins import join_small
    return join_small(logs, subscriptions.select("subscriber", "severity"), "severity", keep=False)


def hourly_counts_stream(logs: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(window, severity, count) with a watermark bounding state."""
    return logs.withWatermark("timestamp", watermark) \
               .groupBy(F.window("timestamp", "1 hour").alias("w"), "severity") \
               .agg(F.count(F.lit(1)).alias("count")) \
               .select(F.col("w.start").alias("hour"), "severity", "count")


def dedupe_stream(logs: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """T4: drop repeated ids within the watermark (streaming form of K1)."""
    return logs.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["id"])


def last_n(batch: DataFrame, n: int = 500) -> DataFrame:
    """The newest ``n`` rows of a feed (distributed top-k)."""
    return batch.orderBy(F.col("timestamp").desc(), F.col("id").asc()).limit(n)


def log_lines_stream(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    """Lines of the log files that arrive in a directory, with file and position."""
    from sieveline.sources.files import LOG_SUFFIXES, _ci_glob
    return (spark.readStream.option("pathGlobFilter", _ci_glob(LOG_SUFFIXES))
            .option("maxFilesPerTrigger", max_files).text(directory)
            .select("value", F.col("_metadata.file_path").alias("source_file"),
                    F.col("_metadata.file_block_start").alias("block_start")))


def _parsed_batch(batch: DataFrame, year: int | None, ingested_at: datetime | None):
    """A micro-batch of lines parsed once: (lines, formats, logs). Files arrive whole, so formats are known."""
    from sieveline.sources.ingest import assign_ids, json_parts, parse_auto
    from sieveline.sources.scratch import written
    from sieveline.sources.sniff import classify, file_profile

    # Written: profile and parse must see the same line numbers.
    lines = written(batch.withColumn("line_no_key", F.monotonically_increasing_id()), "stream-lines")
    profile = written(file_profile(lines), "stream-profile")
    docs, elements, checks = json_parts(batch.sparkSession, profile)
    formats = classify(profile, checks)
    logs = written(assign_ids(parse_auto(lines, formats, docs, year=year, ingested_at=ingested_at, elements=elements)),
                   "stream-logs")
    return lines, formats, logs


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint."""
    import json
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def ingest_stream(spark: SparkSession, directory: str, table_path: str, checkpoint: str,
                  year: int | None = None, ingested_at: datetime | None = None, trigger: dict | None = None,
                  report_path: str | None = None, max_files: int = 1000, vectors_path: str | None = None,
                  embedder=None):
    """Continuous ingest of a directory of log files. Each micro-batch (at
    most ``max_files`` files) is sniffed, parsed once and numbered like a batch
    ingest, whole JSON documents included, and upserted by id into the stored
    table. With ``vectors_path`` the batch's logs that have no stored vector
    are embedded and stored there too (V1, V3). Both tables keep the number of
    the stream's last batch in the same commit as its rows, so a batch that
    comes again is left out by whichever table has it, and a job that ended
    between the two commits is finished on the next run. With ``report_path``
    each batch's report (S6) is written to its own folder there."""
    from sieveline.operators.vectors import embed_logs
    from sieveline.sources.ingest import ingest_report
    from sieveline.sources.snapshots import log_table, store_vectors, vector_table

    def per_batch(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        stream = _query_id(session, checkpoint)
        table = log_table(session, table_path)
        vectors = vector_table(session, vectors_path) if vectors_path else None
        if all(t.version().batches.get(stream, -1) >= epoch for t in (table, vectors) if t is not None):
            return
        lines, formats, logs = _parsed_batch(batch, year, ingested_at)
        table.upsert(logs, stream, epoch)
        if report_path:
            ingest_report(lines, formats, logs).write.mode("overwrite").parquet(f"{report_path}/batch={epoch}")
        if vectors is not None:
            new = logs.join(vectors.read().select("id"), "id", "left_anti")
            store_vectors(vectors, embed_logs(new, embedder), stream, epoch)

    w = log_lines_stream(spark, directory, max_files).writeStream.foreachBatch(per_batch)
    return w.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def text_feed_stream(spark: SparkSession, directory: str, subscriptions: DataFrame, path: str, checkpoint: str,
                     year: int | None = None, ingested_at: datetime | None = None, trigger: dict | None = None,
                     max_files: int = 1000):
    """T1 from raw text: files that arrive are parsed, and each log goes to the subscribers of its severity as the
    feed shows it (N9). Every batch has its own folder, which a batch that comes again overwrites."""
    def per_batch(batch: DataFrame, epoch: int) -> None:
        _, _, logs = _parsed_batch(batch, year, ingested_at)
        fan_out(feed_view(logs), subscriptions).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    w = log_lines_stream(spark, directory, max_files).writeStream.foreachBatch(per_batch)
    return w.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream to completion (availableNow) into a Parquet folder."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregating stream to completion in update mode: every batch
    writes the rows it changed to its own folder (a replayed batch overwrites
    it), so open windows are there too. Read it with ``latest_updates``."""
    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
    q = (stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest_updates(spark: SparkSession, path: str, keys: list[str], schema=None) -> DataFrame:
    """The newest version of each key written by ``run_updates`` (``schema`` of the stream: also where it had no rows)."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema.toDDL()}, batch int")
    rows = reader.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")


def bucket_counts_stream(logs: DataFrame, minutes: int = 10, by: str = "source",
                         watermark: str = "10 minutes") -> DataFrame:
    """T5: streaming counts per (key, ``minutes`` bucket) with a watermark;
    closed buckets feed the z-score step (``zscores_from_counts``)."""
    return logs.withWatermark("timestamp", watermark) \
               .groupBy(F.col(by).alias("key"), F.window("timestamp", f"{minutes} minutes").alias("w")) \
               .agg(F.count(F.lit(1)).alias("count")) \
               .select("key", F.col("w.start").alias("bucket"), "count")


def zscores_from_counts(counts: DataFrame) -> DataFrame:
    """A9/W1 over emitted bucket counts (batch, or per micro-batch in
    ``foreachBatch`` over the counts table): each bucket against its key's
    non-empty buckets, population std."""
    from pyspark.sql import Window
    w = Window.partitionBy("key")
    z = counts.select("*", F.count(F.lit(1)).over(w).alias("n_buckets"), F.avg("count").over(w).alias("mean"),
                      F.stddev_pop("count").over(w).alias("std"))
    return z.withColumn("zscore", F.when(F.col("std") != 0, (F.col("count") - F.col("mean")) / F.col("std")))
