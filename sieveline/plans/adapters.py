"""Driver tables as logs, and logs rendered back to raw text per format.

``events_as_logs`` maps the ``events`` table onto the log schema with plain
expressions that have an exact SQL twin (see ``plans/catalog.py``). The
``render_*`` functions write events as syslog / CEF / CSV / JSON / Windows
text lines so the parsers can be checked against the original columns.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import configure

AS_OF = datetime(2024, 1, 31, 0, 0, 0)
INGESTED_AT = datetime(2024, 2, 1, 0, 0, 0)
YEAR = 2024
CRITICAL_VALUE = 113.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def s(c) -> Column:
    return c.cast("string") if isinstance(c, Column) else F.col(c).cast("string")


def event_severity() -> Column:
    et = F.col("event_type")
    return (F.when((et == "error") & (F.col("value") >= CRITICAL_VALUE), "critical").when(et == "error", "high")
            .when(et == "purchase", "medium").when(et == "signup", "low").otherwise("info"))


def event_message() -> Column:
    et, uid = F.col("event_type"), s("user_id")
    k = F.get_json_object(F.col("props"), "$.k")
    brute = F.when(F.col("value") >= CRITICAL_VALUE, F.lit("Possible brute force attack: ")).otherwise(F.lit(""))
    return (F.when(et == "error", F.concat(brute, F.lit("Failed password for invalid user u"), uid,
                                           F.lit(" from 198.51.100."), s(F.col("user_id") % 250), F.lit(" port "), k))
            .when(et == "purchase", F.concat(F.lit("Accepted payment token for user u"), uid, F.lit(" order "), k))
            .when(et == "signup", F.concat(F.lit("New account created for user u"), uid, F.lit(" notice "), k))
            .when(et == "click", F.concat(F.lit("Connection denied by firewall rule "), k, F.lit(" for user u"), uid))
            .otherwise(F.concat(F.lit("Session opened for user u"), uid, F.lit(" page "), k)))


def events_as_logs(events: DataFrame) -> DataFrame:
    """``events`` in the log schema (+ user_id, event_type, k for fixtures)."""
    ts = F.col("ts").cast("timestamp")
    return events.select(
        s("event_id").alias("id"),
        ts.alias("timestamp"),
        F.concat(F.lit("svc-"), s(F.col("user_id") % 20)).alias("source"),
        F.concat(F.lit("host-"), s(F.col("user_id") % 10)).alias("hostname"),
        event_severity().alias("severity"),
        event_message().alias("message"),
        F.col("props").alias("raw"),
        F.from_json(F.col("props"), "map<string,string>").alias("metadata"),
        F.lit("events.parquet").alias("source_file"),
        F.lit("json").alias("log_type"),
        F.lit("parsed").alias("ts_quality"),
        F.lit(INGESTED_AT).cast("timestamp").alias("ingested_at"),
        F.to_date(ts).alias("event_date"),
        F.col("user_id"), F.col("event_type"), F.col("event_id"),
        F.get_json_object(F.col("props"), "$.k").alias("k"),
    )


def documents_as_logs(documents: DataFrame) -> DataFrame:
    """``documents`` as long-message logs: message = whole text."""
    from sieveline.functions.severity import guess_severity
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 37)
    return documents.select(
        s("doc_id").alias("id"), ts.alias("timestamp"), F.col("source"), F.col("lang").alias("hostname"),
        guess_severity(F.col("text")).alias("severity"), F.col("text").alias("message"), F.col("text").alias("raw"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.lit("documents.parquet").alias("source_file"),
        F.lit("json").alias("log_type"), F.lit("parsed").alias("ts_quality"),
        F.lit(INGESTED_AT).cast("timestamp").alias("ingested_at"), F.to_date(ts).alias("event_date"))


def embeddings_as_vectors(embeddings: DataFrame) -> DataFrame:
    """``embeddings`` keyed like logs (id = vec_id as text)."""
    return embeddings.select(s("vec_id").alias("id"), "embedding", "label")


# --- raw-text renderings -------------------------------------------------------------

SYSLOG_SEVNUM = {"critical": 2, "high": 3, "medium": 4, "low": 5, "info": 6}
CEF_LEVEL = {"critical": 9, "high": 7, "medium": 5, "low": 3, "info": 1}
WINDOWS_LEVEL_NAME = {"critical": "Critical", "high": "Error", "medium": "Warning", "low": "Information",
                      "info": "Verbose"}
WINDOWS_EVENT_ID = {"error": 4625, "purchase": 4624, "signup": 4720, "click": 5157, "view": 4663}
FACILITY = 4


def _map(mapping: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def _lines(df: DataFrame, value: Column, source_file: Column, key: Column | None = None) -> DataFrame:
    out = df.select(value.alias("value"), source_file.alias("source_file"), F.lit(0).cast("long").alias("block_start"),
                    (key if key is not None else F.col("event_id")).cast("long").alias("line_no_key"))
    return spread(out)


def spread(df: DataFrame) -> DataFrame:
    """Rendered text comes from one small table file (one input split); spread
    it over the cluster like a directory of log files would be. Line order is
    kept by the explicit (block_start, line_no_key) position, not by the
    partitioning."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(n, 1))


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def syslog3164_text(logs: DataFrame) -> Column:
    """``[<PRI>]Mon D HH:MM:SS host app[pid]: message``; PRI only for
    error/purchase/signup events (others test the keyword guess)."""
    pri = F.lit(FACILITY * 8) + _map(SYSLOG_SEVNUM, F.col("severity"))
    head = F.when(F.col("event_type").isin("error", "purchase", "signup"),
                  F.concat(F.lit("<"), s(pri), F.lit(">"))).otherwise(F.lit(""))
    return F.concat(head, F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" "), F.col("hostname"), F.lit(" "),
                    F.col("source"), F.lit("["), s("user_id"), F.lit("]: "), F.col("message"))


def syslog5424_text(logs: DataFrame) -> Column:
    pri = F.lit(FACILITY * 8) + _map(SYSLOG_SEVNUM, F.col("severity"))
    return F.concat(F.lit("<"), s(pri), F.lit(">1 "), iso_micros(F.col("timestamp")), F.lit("Z "), F.col("hostname"),
                    F.lit(" "), F.col("source"), F.lit(" "), s("user_id"), F.lit(" "), F.col("event_type"), F.lit(" "),
                    F.col("message"))


def cef_text(logs: DataFrame) -> Column:
    uid = F.col("user_id")
    src = F.concat(F.lit("10.0."), s(F.floor(uid / 256)), F.lit("."), s(uid % 256))
    rt = s(F.floor(F.unix_micros("timestamp") / 1000))
    return F.concat(F.lit("CEF:0|Acme|LogGen|1.0|"), F.col("event_type"), F.lit("|"), F.col("message"), F.lit("|"),
                    s(_map(CEF_LEVEL, F.col("severity"))), F.lit("|src="), src, F.lit(" dhost="), F.col("hostname"),
                    F.lit(" rt="), rt, F.lit(" cs1="), F.col("k"), F.lit(" act="), F.col("event_type"))


CSV_HEADER = "timestamp,src_ip,dst_ip,action,level,bytes"


def csv_text(logs: DataFrame) -> Column:
    uid = F.col("user_id")
    src = F.concat(F.lit("10.0."), s(F.floor(uid / 256)), F.lit("."), s(uid % 256))
    return F.concat_ws(",", iso_micros(F.col("timestamp")), src, F.concat(F.lit("192.0.2."), F.col("k")),
                       F.col("event_type"), F.col("severity"), F.col("k"))


def jsonl_text(logs: DataFrame) -> Column:
    return F.to_json(F.struct(iso_micros(F.col("timestamp")).alias("timestamp"), F.col("message").alias("message"),
                              F.col("severity").alias("level"), F.col("hostname").alias("host"),
                              F.col("user_id").alias("user"), F.col("k").alias("k")))


def windows_text(logs: DataFrame) -> Column:
    return F.to_json(F.struct(
        _map(WINDOWS_EVENT_ID, F.col("event_type")).alias("EventID"),
        _map(WINDOWS_LEVEL_NAME, F.col("severity")).alias("Level"),
        F.struct(F.concat(iso_micros(F.col("timestamp")), F.lit("Z")).alias("SystemTime")).alias("TimeCreated"),
        F.col("hostname").alias("Computer"), F.col("source").alias("Source"), F.col("message").alias("Message")))


def render(logs: DataFrame, fmt: str, per_user_files: bool = True) -> DataFrame:
    """Events rendered as raw lines of one format; one "file" per user
    (``u<user_id>.<fmt>``). CSV files get a header line first."""
    text = {"syslog3164": syslog3164_text, "syslog5424": syslog5424_text, "cef": cef_text, "csv": csv_text,
            "jsonl": jsonl_text, "windows": windows_text}[fmt](logs)
    fname = F.concat(F.lit("u"), s("user_id"), F.lit("." + fmt)) if per_user_files else F.lit("all." + fmt)
    lines = _lines(logs, text, fname)
    if fmt == "csv":
        files = logs.select(fname.alias("source_file")).distinct()
        header = files.select(F.lit(CSV_HEADER).alias("value"), "source_file", F.lit(0).cast("long").alias("block_start"),
                              F.lit(-1).cast("long").alias("line_no_key"))
        lines = header.unionByName(lines)
    return lines


# Format of each user's file in the mixed-format fixture, by user_id % 6.
MIXED_FORMATS = ["cef", "syslog3164", "syslog5424", "csv", "jsonl", "windows"]


def render_mixed(logs: DataFrame) -> DataFrame:
    """One file per user, its format chosen by user_id % 6; in CEF files the
    ``view`` events are written as plain text (non-CEF lines = rejects);
    Windows-shaped objects are written as JSON lines (so they detect as json)."""
    fmt_idx = F.col("user_id") % 6
    fname = F.concat(F.lit("u"), s("user_id"))
    texts = {name: fn(logs) for name, fn in (("cef", cef_text), ("syslog3164", syslog3164_text),
                                               ("syslog5424", syslog5424_text), ("csv", csv_text),
                                               ("jsonl", jsonl_text), ("windows", windows_text))}
    value = F.lit(None).cast("string")
    for i, name in enumerate(MIXED_FORMATS):
        t = texts[name]
        if name == "cef":
            t = F.when(F.col("event_type") == "view", F.concat(F.lit("view event "), F.col("id"))).otherwise(t)
        value = F.when(fmt_idx == i, t).otherwise(value)
    lines = _lines(logs, value, fname)
    csv_files = logs.where(fmt_idx == 3).select(fname.alias("source_file")).distinct()
    header = csv_files.select(F.lit(CSV_HEADER).alias("value"), "source_file", F.lit(0).cast("long").alias("block_start"),
                              F.lit(-1).cast("long").alias("line_no_key"))
    return header.unionByName(lines)
