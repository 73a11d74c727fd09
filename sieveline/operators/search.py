"""Filters, paging, lookups and anti/semi joins over a logs DataFrame
(P1-P15, L1-L2, L8, J1, J6, K4)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import contains_ci
from sieveline.functions.timeparse import to_timestamp_literal


def _given(v) -> bool:
    return v is not None and not (isinstance(v, str) and v == "")


def search_condition(query: str | None = None, severity: str | None = None, source: str | None = None,
                     hostname: str | None = None, log_type: str | None = None,
                     start_time: str | datetime | None = None, end_time: str | datetime | None = None) -> Column:
    """Conjunction of the filters that are given (empty = absent).

    Text filters are case-insensitive ``%value%`` patterns with live ``%``/``_``
    wildcards; severity and log type compare lower-cased; the time range is
    inclusive (a date-only end means midnight).
    """
    conds: list[Column] = []
    if _given(query):
        conds.append(contains_ci(F.col("message"), query))
    if _given(severity):
        conds.append(F.col("severity") == F.lit(severity.lower()))
    if _given(source):
        conds.append(contains_ci(F.col("source"), source) | contains_ci(F.col("hostname"), source))
    if _given(hostname):
        conds.append(contains_ci(F.col("hostname"), hostname))
    if _given(log_type):
        conds.append(F.col("log_type") == F.lit(log_type.lower()))
    if _given(start_time):
        conds.append(F.col("timestamp") >= to_timestamp_literal(start_time))
    if _given(end_time):
        conds.append(F.col("timestamp") <= to_timestamp_literal(end_time))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def date_bounds(logs: DataFrame, start_time=None, end_time=None) -> Column:
    """Partition predicate implied by a time range: ``event_date`` is
    ``to_date(timestamp)``, so a stored table partitioned by it is pruned to
    the days in range (Spark does not derive this from the timestamp filter)."""
    cond = F.lit(True)
    if "event_date" not in logs.columns:
        return cond
    if _given(start_time):
        cond = cond & (F.col("event_date") >= F.to_date(to_timestamp_literal(start_time)))
    if _given(end_time):
        cond = cond & (F.col("event_date") <= F.to_date(to_timestamp_literal(end_time)))
    return cond


def filter_logs(logs: DataFrame, **filters) -> DataFrame:
    """All matching rows, unordered (no limit)."""
    return logs.where(search_condition(**filters) & date_bounds(logs, filters.get("start_time"),
                                                                filters.get("end_time")))


def newest_first(logs: DataFrame, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """L1: newest first with ``id`` as tie-break, then OFFSET/LIMIT.
    Planned as one distributed TakeOrderedAndProject."""
    out = logs.orderBy(F.col("timestamp").desc(), F.col("id").asc())
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def oldest_first(logs: DataFrame, limit: int | None = 100) -> DataFrame:
    """L2."""
    out = logs.orderBy(F.col("timestamp").asc(), F.col("id").asc())
    return out.limit(limit) if limit is not None else out


def search_logs(logs: DataFrame, query=None, severity=None, source=None, hostname=None, log_type=None,
                start_time=None, end_time=None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """P7 + L1: the filtered page, newest first."""
    cond = search_condition(query, severity, source, hostname, log_type, start_time, end_time)
    return newest_first(logs.where(cond & date_bounds(logs, start_time, end_time)), limit, offset)


def count_logs(logs: DataFrame, severity: str | None = None, source: str | None = None) -> DataFrame:
    """A1: count with optional severity and source-contains (source only)."""
    cond = F.lit(True)
    if _given(severity):
        cond = cond & (F.col("severity") == F.lit(severity.lower()))
    if _given(source):
        cond = cond & contains_ci(F.col("source"), source)
    return logs.where(cond).agg(F.count(F.lit(1)).alias("n"))


def recent(logs: DataFrame, as_of, minutes: int = 60) -> DataFrame:
    """Rows in ``[as_of - minutes, as_of]``."""
    end = to_timestamp_literal(as_of)
    start = end - F.make_dt_interval(mins=F.lit(minutes))
    return logs.where(F.col("timestamp").between(start, end) & date_bounds(logs, start, end))


def lookup(logs: DataFrame, ids: DataFrame, id_col: str = "id", pos_col: str | None = None) -> DataFrame:
    """Rows for the requested ids, missing ids dropped, request order kept.

    ``ids`` has ``id_col`` and optionally a position. The join is a plain
    equi-join: AQE broadcasts the id list when it is small and keeps a
    shuffle join when it is not.
    """
    req = ids.withColumn("id", F.col(id_col).cast("string"))
    out = logs.join(req, "id")
    return out.orderBy(pos_col) if pos_col else out


def unembedded(logs: DataFrame, embeddings: DataFrame, limit: int | None = 100) -> DataFrame:
    """Logs without a vector (anti join), oldest first."""
    return oldest_first(logs.join(embeddings.select("id"), "id", "left_anti"), limit)


def with_embedded_flag(logs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """K4: ``embedded`` = the log has a stored vector (left join on id)."""
    flags = embeddings.select("id").distinct().withColumn("embedded", F.lit(True))
    return logs.join(flags, "id", "left").withColumn("embedded", F.coalesce(F.col("embedded"), F.lit(False)))


def high_severity(logs: DataFrame) -> DataFrame:
    """P14."""
    return logs.where(F.col("severity").isin("critical", "high"))
