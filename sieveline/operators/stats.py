"""Counts, dashboard statistics and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.schema import SEVERITIES


def hourly_severity_counts(logs: DataFrame) -> DataFrame:
    """(hour, severity, count): the one aggregate the dashboard is rolled up
    from; partial aggregation keeps the shuffle to hours x severities."""
    return logs.groupBy(F.date_trunc("hour", F.col("timestamp")).alias("hour"), "severity") \
               .agg(F.count(F.lit(1)).alias("count"))


def severity_counts(logs: DataFrame) -> DataFrame:
    """A2+A3: total and the five severity counts in one pass (absent = 0)."""
    return logs.agg(
        F.count(F.lit(1)).alias("total_logs"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES],
    )


def distinct_sources(logs: DataFrame, n: int | None = 50) -> DataFrame:
    """Distinct non-empty sources, sorted, first ``n``."""
    out = logs.where(F.col("source") != "").select("source").distinct().orderBy("source")
    return out.limit(n) if n is not None else out


def timeline(logs: DataFrame, limit: int | None = 500) -> DataFrame:
    """A5: (hour, severity, count), newest hour first (severity tie-break)."""
    out = hourly_severity_counts(logs).orderBy(F.col("hour").desc(), F.col("severity").asc())
    return out.limit(limit) if limit is not None else out


def timeline_wide(logs: DataFrame) -> DataFrame:
    """One row per hour, five zero-filled severity columns, oldest first."""
    wide = hourly_severity_counts(logs).groupBy("hour").pivot("severity", SEVERITIES).agg(F.sum("count"))
    return wide.select("hour", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in SEVERITIES]) \
               .orderBy("hour")


def dashboard_stats(logs: DataFrame, anomalies: DataFrame | None = None, n_sources: int = 50) -> DataFrame:
    """One row -- total, per-severity counts, number of distinct sources,
    the first ``n_sources`` sources (joined text), anomaly count (Q20: real).

    Counts are rolled up from the small (hour, severity) aggregate, so the
    log table is scanned once for counts and once for the distinct sources.
    """
    hs = hourly_severity_counts(logs)
    counts = hs.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_logs"),
        *[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0)).cast("long")
          .alias(f"{s}_count") for s in SEVERITIES],
        F.count(F.lit(1)).alias("timeline_rows"),
    )
    srcs = logs.where(F.col("source") != "").select("source").distinct()
    # One-row side tables enter as scalar subqueries (run once, no join).
    out = counts.withColumn("source_count", srcs.agg(F.count(F.lit(1))).scalar())
    if n_sources:
        # Distributed top-n (TakeOrderedAndProject), never a collect of all sources.
        first = distinct_sources(logs, n_sources)
        out = out.withColumn("sources", first.agg(
            F.coalesce(F.array_join(F.array_sort(F.collect_list("source")), ","), F.lit(""))).scalar())
    return out.withColumn("anomalies_detected", _anomaly_count(anomalies))


def _anomaly_count(anomalies: DataFrame | None):
    """Logs with an anomaly: distinct ``log_id``, or rows where there is one row per log and no id was looked up."""
    if anomalies is None:
        return F.lit(0).cast("long")
    n = F.count_distinct("log_id") if "log_id" in anomalies.columns else F.count(F.lit(1))
    return anomalies.agg(n).scalar().cast("long")


def dashboard(logs: DataFrame, anomalies: DataFrame | None = None, n_sources: int = 50, limit: int = 500) -> DataFrame:
    """A7 whole: ``dashboard_stats`` with the timeline's newest ``limit`` rows as an array of (hour, severity, count)."""
    rows = timeline(logs, limit).agg(F.collect_list(F.struct("hour", "severity", "count")).alias("t"))
    ordered = F.array_sort(F.col("t"), lambda a, b: F.when(a["hour"] > b["hour"], -1).when(a["hour"] < b["hour"], 1)
                           .when(a["severity"] < b["severity"], -1).when(a["severity"] > b["severity"], 1).otherwise(0))
    return dashboard_stats(logs, anomalies, n_sources).withColumn("timeline", rows.select(ordered).scalar())


def severity_distribution(logs: DataFrame) -> DataFrame:
    """(severity, count) over the five labels, zero rows removed."""
    return logs.where(F.col("severity").isin(*SEVERITIES)).groupBy("severity") \
               .agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 0)


def stat_cards(logs: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Total, critical, number of distinct sources, logs with an anomaly."""
    cards = logs.agg(F.count(F.lit(1)).alias("total_logs"),
                    F.count_if(F.col("severity") == "critical").alias("critical_count"),
                    F.count_distinct(F.nullif(F.col("source"), F.lit(""))).alias("source_count"))
    return cards.withColumn("anomalies_detected", _anomaly_count(anomalies))
