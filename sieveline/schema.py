"""Target log schema and the fixed severity vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# Normalised log row produced by every parser.
LOG_FIELDS = [
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("source_file", T.StringType()),
    T.StructField("log_type", T.StringType()),
    T.StructField("ts_quality", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("event_date", T.DateType()),
]
LOG_SCHEMA = T.StructType(LOG_FIELDS)
LOG_COLUMNS = [f.name for f in LOG_FIELDS]

# --- fixed values (must equal the original tool's vocabulary) ---------------
# Severities, most severe first.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
# Ordering used for "max severity": info < low < medium < high < critical.
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
# Threat-score weight per severity.
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2, "info": 0.0}
# Log types.
LOG_TYPES = ["syslog", "windows_event", "json", "csv", "cef", "unknown"]
# Severities counted as "high" by the escalation detector.
HIGH_SEVERITIES = ["critical", "high"]
# ---------------------------------------------------------------------------

TS_QUALITY = ["parsed", "assumed_year", "epoch", "missing"]
