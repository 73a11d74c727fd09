"""Registered queries: the Spark plan of each operator on the driver tables
and, where SQL can express it, the DuckDB oracle with the same columns.

Every query reads the given tables (or data Spark derives from them) whole.
Timestamps leave as TIMESTAMP_NTZ and doubles are rounded to 6 digits so
both engines print the same values.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions.severity import guess_severity, threat_score
from sieveline.functions.text import CHAT_PREVIEW, FEED_PREVIEW, embed_text, preview
from sieveline.operators import anomalies, hunts, incidents, search, stats, vectors
from sieveline.plans import adapters as A
from sieveline.sources import ingest, sinks
from sieveline.sources.sniff import sniff_formats
from sieveline.streaming import feed

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def ntz(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz")


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def _logs(spark: SparkSession, d: str, spread: bool = False) -> DataFrame:
    """Events as logs. ``spread``: the table is one small file (one input
    split); heavy per-row queries spread it like a multi-file input."""
    events = A.table(spark, d, "events")
    # Spread by hash before the rows get wide: no task sorts or holds a whole input split.
    return A.events_as_logs(events.repartition(max(spark.sparkContext.defaultParallelism, 1), "event_id", "ts", "user_id")
                            if spread else events)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return A.documents_as_logs(A.table(spark, d, "documents"))


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return A.embeddings_as_vectors(A.table(spark, d, "embeddings"))


LOG_OUT = ["id", "timestamp", "source", "hostname", "severity", "message"]


def _out(df: DataFrame, cols=LOG_OUT) -> DataFrame:
    return df.select(*[ntz(c).alias(c) if c == "timestamp" else F.col(c) for c in cols])


Q: dict[str, callable] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# --- SQL twins of the adapters ------------------------------------------------------------
_K = "json_extract_string(props, '$.k')"
_UID = "CAST(user_id AS VARCHAR)"
LOGS_CTE = f"""logs AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ts AS "timestamp",
    'svc-' || CAST(user_id % 20 AS VARCHAR) AS source,
    'host-' || CAST(user_id % 10 AS VARCHAR) AS hostname,
    CASE WHEN event_type = 'error' AND value >= 113.0 THEN 'critical' WHEN event_type = 'error' THEN 'high'
         WHEN event_type = 'purchase' THEN 'medium' WHEN event_type = 'signup' THEN 'low' ELSE 'info' END AS severity,
    CASE WHEN event_type = 'error' THEN (CASE WHEN value >= 113.0 THEN 'Possible brute force attack: ' ELSE '' END)
              || 'Failed password for invalid user u' || {_UID} || ' from 198.51.100.'
              || CAST(user_id % 250 AS VARCHAR) || ' port ' || {_K}
         WHEN event_type = 'purchase' THEN 'Accepted payment token for user u' || {_UID} || ' order ' || {_K}
         WHEN event_type = 'signup' THEN 'New account created for user u' || {_UID} || ' notice ' || {_K}
         WHEN event_type = 'click' THEN 'Connection denied by firewall rule ' || {_K} || ' for user u' || {_UID}
         ELSE 'Session opened for user u' || {_UID} || ' page ' || {_K} END AS message,
    user_id, event_type, event_id, {_K} AS k
  FROM events)"""
DOCS_CTE = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, to_timestamp(1704067200 + doc_id * 37)::TIMESTAMP AS "timestamp",
         source, lang AS hostname, text AS message FROM documents)"""


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def guess_sql(x: str) -> str:
    from sieveline.functions.severity import KEYWORD_SEVERITY
    parts = [f"WHEN regexp_matches({x}, '(?i)\\b({'|'.join(w)})\\b') THEN '{sev}'" for sev, w in KEYWORD_SEVERITY]
    return "CASE " + " ".join(parts) + " ELSE 'info' END"


_BUCKETS_CTE = """b AS (SELECT source AS key, time_bucket(INTERVAL 10 MINUTE, "timestamp") AS bucket, count(*) AS count,
                  arg_max(id, "timestamp") AS log_id FROM logs GROUP BY ALL),
z AS (SELECT *, count(*) OVER (PARTITION BY key) AS n_buckets, avg(count) OVER (PARTITION BY key) AS mean,
             stddev_pop(count) OVER (PARTITION BY key) AS std FROM b),
zz AS (SELECT *, CASE WHEN std <> 0 THEN (count - mean) / std END AS zscore FROM z)"""
_FREQ_WHERE = "(SELECT count(*) FROM logs) >= 5 AND n_buckets >= 3 AND zscore > 2.0"
_FREQ_SQL = f"""
SELECT log_id, key, round(least(zscore / 5.0, 1.0), 6) AS score, 'frequency_zscore' AS method FROM zz
WHERE {_FREQ_WHERE}"""

SEL_LOG = 'id, "timestamp", source, hostname, severity, message'

# --- dashboard, timelines, search (A1-A7, A16, P1-P7, L1) --------------------------------------


@register("dashboard_stats", W(LOGS_CTE, _BUCKETS_CTE) + f"""
SELECT count(*) AS total_logs,
  count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'high') AS high_count,
  count(*) FILTER (WHERE severity = 'medium') AS medium_count, count(*) FILTER (WHERE severity = 'low') AS low_count,
  count(*) FILTER (WHERE severity = 'info') AS info_count,
  (SELECT count(*) FROM (SELECT DISTINCT date_trunc('hour', "timestamp"), severity FROM logs)) AS timeline_rows,
  (SELECT count(DISTINCT source) FROM logs WHERE source <> '') AS source_count,
  (SELECT string_agg(source, ',' ORDER BY source) FROM
     (SELECT DISTINCT source FROM logs WHERE source <> '' ORDER BY source LIMIT 50)) AS sources,
  (SELECT count(DISTINCT log_id) FROM zz WHERE {_FREQ_WHERE}) AS anomalies_detected
FROM logs""")
def q_dashboard_stats(spark, d):
    """The anomaly count is that of frequency spikes."""
    logs = _logs(spark, d)
    return stats.dashboard_stats(logs, anomalies.spike_buckets(logs))


@register("dashboard_timeline", W(LOGS_CTE) + """
, t AS (SELECT date_trunc('hour', "timestamp") AS hour, severity, count(*) AS count FROM logs GROUP BY ALL
        ORDER BY hour DESC, severity LIMIT 500)
SELECT (SELECT count(*) FROM logs) AS total_logs, row_number() OVER (ORDER BY hour DESC, severity) - 1 AS place, hour,
       severity, count FROM t""")
def q_dashboard_timeline(spark, d):
    """A7's timeline rows, as the statistics hold them."""
    board = stats.dashboard(_logs(spark, d))
    out = board.select("total_logs", F.posexplode("timeline").alias("place", "r")).select(
        "total_logs", F.col("place").cast("long"), "r.*")
    return out.withColumn("hour", ntz("hour"))


@register("timeline_hourly", W(LOGS_CTE) + """
SELECT date_trunc('hour', "timestamp") AS hour, severity, count(*) AS count FROM logs
GROUP BY ALL""")
def q_timeline_hourly(spark, d):
    t = stats.timeline(_logs(spark, d), limit=None)
    return t.select(ntz("hour").alias("hour"), "severity", "count")


@register("timeline_wide", W(LOGS_CTE) + """
SELECT date_trunc('hour', "timestamp") AS hour,
  count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
  count(*) FILTER (WHERE severity = 'info') AS info
FROM logs GROUP BY 1""")
def q_timeline_wide(spark, d):
    t = stats.timeline_wide(_logs(spark, d))
    return t.withColumn("hour", ntz("hour"))


@register("search_message", W(LOGS_CTE) + f"""
SELECT {SEL_LOG} FROM logs WHERE message ILIKE '%failed password%'
ORDER BY "timestamp" DESC, id LIMIT 100""")
def q_search_message(spark, d):
    return _out(search.search_logs(_logs(spark, d), query="failed password", limit=100))


@register("search_source_or_host", W(LOGS_CTE) + f"""
SELECT {SEL_LOG} FROM logs WHERE source ILIKE '%svc-1%' OR hostname ILIKE '%svc-1%'""")
def q_search_source_or_host(spark, d):
    return _out(search.search_logs(_logs(spark, d), source="svc-1", limit=None))


@register("search_time_range", W(LOGS_CTE) + f"""
SELECT {SEL_LOG} FROM logs
WHERE severity = 'high' AND "timestamp" >= TIMESTAMP '2024-01-10 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-12 00:00:00'""")
def q_search_time_range(spark, d):
    return _out(search.search_logs(_logs(spark, d), severity="HIGH", start_time="2024-01-10",
                                   end_time="2024-01-12", limit=None))


@register("search_page", W(LOGS_CTE) + f"""
SELECT {SEL_LOG} FROM logs WHERE message ILIKE '%user u1%'
ORDER BY "timestamp" DESC, id LIMIT 100 OFFSET 100""")
def q_search_page(spark, d):
    return _out(search.search_logs(_logs(spark, d), query="user u1", log_type="JSON", limit=100, offset=100))


@register("search_documents", W(DOCS_CTE) + """
SELECT id, source, hostname, length(message) AS n_chars FROM docs WHERE message ILIKE '%license%'""")
def q_search_documents(spark, d):
    out = search.search_logs(_docs(spark, d), query="license", limit=None)
    return out.select("id", "source", "hostname", F.length("message").cast("long").alias("n_chars"))


@register("count_filtered", W(LOGS_CTE) + """
SELECT count(*) AS n FROM logs WHERE severity = 'high' AND source ILIKE '%svc-1%'""")
def q_count_filtered(spark, d):
    return search.count_logs(_logs(spark, d), severity="high", source="svc-1")


@register("distinct_sources", W(LOGS_CTE) + """
SELECT DISTINCT source FROM logs WHERE source <> '' ORDER BY source LIMIT 50""")
def q_distinct_sources(spark, d):
    return stats.distinct_sources(_logs(spark, d), 50)


@register("severity_distribution", W(LOGS_CTE) + """
SELECT severity, count(*) AS count FROM logs GROUP BY severity HAVING count(*) > 0""")
def q_severity_distribution(spark, d):
    return stats.severity_distribution(_logs(spark, d))


@register("stat_cards", W(LOGS_CTE, _BUCKETS_CTE) + f"""
SELECT count(*) AS total_logs, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
       count(DISTINCT NULLIF(source, '')) AS source_count,
       (SELECT count(DISTINCT log_id) FROM zz WHERE {_FREQ_WHERE}) AS anomalies_detected FROM logs""")
def q_stat_cards(spark, d):
    logs = _logs(spark, d)
    return stats.stat_cards(logs, anomalies.spike_buckets(logs))


# --- joins, storage (J1, J6, K1-K4) -------------------------------------------------------------

@register("lookup_ids", """
SELECT CAST(d.doc_id AS VARCHAR) AS id, d.source, d.lang AS hostname, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_lookup_ids(spark, d):
    lab = A.table(spark, d, "labels")
    out = search.lookup(_docs(spark, d), lab.select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic"))
    return out.select("id", "source", "hostname", "quality", "toxic")


@register("unembedded_oldest", W(LOGS_CTE) + """
SELECT id, "timestamp" FROM logs
WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE CAST(e.vec_id AS VARCHAR) = logs.id)
ORDER BY "timestamp", id LIMIT 100""")
def q_unembedded_oldest(spark, d):
    out = search.unembedded(_logs(spark, d), _emb(spark, d), limit=100)
    return out.select("id", ntz("timestamp").alias("timestamp"))


@register("embedded_flag", W(LOGS_CTE) + """
SELECT id, EXISTS (SELECT 1 FROM embeddings e WHERE CAST(e.vec_id AS VARCHAR) = logs.id) AS embedded FROM logs""")
def q_embedded_flag(spark, d):
    return search.with_embedded_flag(_logs(spark, d), _emb(spark, d)).select("id", "embedded")


@register("upsert_logs", W(LOGS_CTE) + """
SELECT id, CASE WHEN event_type = 'error' THEN 'REVIEWED ' || message ELSE message END AS message, severity,
       CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-02-02 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END
         AS ingested_at
FROM logs""")
def q_upsert_logs(spark, d):
    logs = _logs(spark, d)
    new = logs.where(F.col("event_type") == "error") \
              .withColumn("message", F.concat(F.lit("REVIEWED "), F.col("message"))) \
              .withColumn("ingested_at", F.lit(A.INGESTED_AT + timedelta(days=1)).cast("timestamp"))
    out = sinks.upsert_logs(logs, new)
    return out.select("id", "message", "severity", ntz("ingested_at").alias("ingested_at"))


@register("delete_logs", W(LOGS_CTE) + """
SELECT id, severity FROM logs
WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE CAST(e.vec_id AS VARCHAR) = logs.id)""")
def q_delete_logs(spark, d):
    return sinks.delete_logs(_logs(spark, d), _emb(spark, d)).select("id", "severity")


@register("deleted_count", W(LOGS_CTE) + """
SELECT count(*) AS deleted FROM logs
WHERE EXISTS (SELECT 1 FROM embeddings e WHERE CAST(e.vec_id AS VARCHAR) = logs.id)""")
def q_deleted_count(spark, d):
    return sinks.deleted_count(_logs(spark, d), _emb(spark, d))


# --- scalar functions (F1, F8, N8, N10, N11) ----------------------------------------------------

@register("guess_severity", W(LOGS_CTE, DOCS_CTE) + f"""
SELECT 'event' AS kind, id, {guess_sql('message')} AS guessed FROM logs
UNION ALL
SELECT 'document' AS kind, id, {guess_sql('message')} AS guessed FROM docs""")
def q_guess_severity(spark, d):
    ev = _logs(spark, d).select(F.lit("event").alias("kind"), "id", guess_severity(F.col("message")).alias("guessed"))
    dc = _docs(spark, d).select(F.lit("document").alias("kind"), "id", F.col("severity").alias("guessed"))
    return ev.unionByName(dc)


def _threat_sql() -> str:
    from sieveline.functions.severity import THREAT_KEYWORDS
    w = ("CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 "
         "WHEN 'low' THEN 0.2 ELSE 0.0 END * 0.5")
    terms = "".join(f"\n  + CASE WHEN strpos(lower(message), '{k}') > 0 THEN {b} ELSE 0.0 END" for k, b in THREAT_KEYWORDS)
    return f"round(least(1.0, {w}{terms}), 6)"


@register("threat_score", W(LOGS_CTE) + f"SELECT id, severity, {_threat_sql()} AS score FROM logs")
def q_threat_score(spark, d):
    logs = _logs(spark, d)
    return logs.select("id", "severity", r6(threat_score(F.col("severity"), F.col("message"))).alias("score"))


@register("threat_score_rules", W(LOGS_CTE) + f"SELECT id, severity, {_threat_sql()} AS score FROM logs")
def q_threat_score_rules(spark, d):
    """F8 with the fixed rules as a table."""
    from sieveline.operators import rules
    out = rules.score_by_rules(_logs(spark, d), rules.default_rules(spark))
    return out.select("id", "severity", r6("score").alias("score"))


@register("threat_score_many_rules", W(LOGS_CTE) + """
, rules AS (SELECT DISTINCT 'user u' || CAST(user_id AS VARCHAR) AS keyword, (user_id % 7) / 100.0 AS boost FROM events
            UNION ALL SELECT DISTINCT 'page ' || CAST(k AS VARCHAR), 0.05 FROM logs)
SELECT l.id, l.severity, round(least(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5
                                                   WHEN 'low' THEN 0.2 ELSE 0.0 END * 0.5
                                     + coalesce((SELECT sum(boost) FROM rules WHERE contains(lower(l.message), keyword)), 0),
                                     1.0), 6)::DOUBLE AS score
FROM logs l""")
def q_threat_score_many_rules(spark, d):
    """F8 with a rule for every user and every page of the data."""
    from sieveline.operators import rules
    logs = _logs(spark, d)
    users = logs.select(F.concat(F.lit("user u"), A.s("user_id")).alias("keyword"),
                        ((F.col("user_id") % 7) / 100.0).alias("boost")).distinct()
    pages = logs.select(F.concat(F.lit("page "), F.col("k")).alias("keyword"), F.lit(0.05).alias("boost")).distinct()
    given = users.unionByName(pages).withColumn("position", F.lit(0))
    return rules.score_by_rules(logs, given).select("id", "severity", r6("score").alias("score"))


@register("embed_text", W(LOGS_CTE) + """
SELECT id, concat_ws(' ', '[' || upper(severity) || ']', CASE WHEN source <> '' THEN 'source=' || source END,
                     CASE WHEN hostname <> '' THEN 'host=' || hostname END,
                     CASE WHEN message <> '' THEN message END) AS embed_text FROM logs""")
def q_embed_text(spark, d):
    logs = _logs(spark, d)
    return logs.select("id", embed_text(F.col("severity"), F.col("source"), F.col("hostname"),
                                        F.col("message")).alias("embed_text"))


@register("preview", W(DOCS_CTE) + f"""
SELECT id, CASE WHEN length(message) > {FEED_PREVIEW} THEN substr(message, 1, {FEED_PREVIEW}) || '...'
                ELSE message END AS feed_preview,
           CASE WHEN length(message) > {CHAT_PREVIEW} THEN substr(message, 1, {CHAT_PREVIEW}) || '...'
                ELSE message END AS chat_preview FROM docs""")
def q_preview(spark, d):
    docs = _docs(spark, d)
    return docs.select("id", preview(F.col("message"), FEED_PREVIEW).alias("feed_preview"),
                       preview(F.col("message"), CHAT_PREVIEW).alias("chat_preview"))


_ISO_SQL = ("strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(\"timestamp\") % 1000000 = 0 THEN '' "
            "ELSE '.' || lpad(CAST(epoch_us(\"timestamp\") % 1000000 AS VARCHAR), 6, '0') END")


@register("render_lines", W(LOGS_CTE) + f"""
SELECT id, "timestamp", '[' || {_ISO_SQL} || '] [' || upper(severity) || '] host='
  || coalesce(nullif(hostname, ''), source) || ' | ' || message AS line FROM logs""")
def q_render_lines(spark, d):
    out = incidents.render_lines(_logs(spark, d))
    return out.select("id", ntz("timestamp").alias("timestamp"), "line")


# --- parsers: render events as raw text in Spark, parse back (N1-N7, S4-S6) -----------------------

def _parsed(spark, d, fmt: str) -> DataFrame:
    logs = _logs(spark, d)
    lines = A.render(logs, fmt)
    formats = sniff_formats(lines)
    return ingest.parse_auto(lines, formats, year=A.YEAR, ingested_at=A.INGESTED_AT)


def _rt_cols(df: DataFrame, extra: list[Column]) -> DataFrame:
    return df.select(F.col("line_no_key").cast("string").alias("id"), ntz("timestamp").alias("timestamp"),
                     "source", "hostname", "severity", "message", "log_type", "ts_quality", *extra)


@register("syslog3164_roundtrip", W(LOGS_CTE) + """
SELECT id, date_trunc('second', "timestamp") AS "timestamp", source, hostname, severity, message,
       'syslog' AS log_type, 'assumed_year' AS ts_quality, CAST(user_id AS VARCHAR) AS pid FROM logs""")
def q_syslog3164_roundtrip(spark, d):
    return _rt_cols(_parsed(spark, d, "syslog3164"), [F.col("metadata")["pid"].alias("pid")])


@register("syslog5424_roundtrip", W(LOGS_CTE) + """
SELECT id, "timestamp", source, hostname, severity, message,
       'syslog' AS log_type, 'parsed' AS ts_quality, '4' AS facility FROM logs""")
def q_syslog5424_roundtrip(spark, d):
    return _rt_cols(_parsed(spark, d, "syslog5424"), [F.col("metadata")["facility"].alias("facility")])


@register("cef_roundtrip", W(LOGS_CTE) + """
SELECT id, date_trunc('millisecond', "timestamp") AS "timestamp",
       '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS source,
       hostname, severity, message, 'cef' AS log_type, 'epoch' AS ts_quality, k AS cs1, 'Acme' AS vendor,
       event_type AS signature_id FROM logs""")
def q_cef_roundtrip(spark, d):
    m = F.col("metadata")
    return _rt_cols(_parsed(spark, d, "cef"), [m["cs1"].alias("cs1"), m["vendor"].alias("vendor"),
                                               m["signature_id"].alias("signature_id")])


@register("csv_roundtrip", W(LOGS_CTE) + """
SELECT id, "timestamp", '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS source,
       '' AS hostname, severity, event_type AS message, 'csv' AS log_type, 'parsed' AS ts_quality,
       '192.0.2.' || k AS dst_ip, k AS bytes FROM logs""")
def q_csv_roundtrip(spark, d):
    m = F.col("metadata")
    return _rt_cols(_parsed(spark, d, "csv"), [m["dst_ip"].alias("dst_ip"), m["bytes"].alias("bytes")])


_RAGGED = "event_id % 7"
_RAGGED_HEADER = "timestamp,src_ip,message,note"


@register("csv_ragged", W(LOGS_CTE) + f"""
SELECT id, CASE WHEN {_RAGGED} IN (2, 5) THEN TIMESTAMP '2024-02-01 00:00:00' ELSE "timestamp" END AS "timestamp",
  CASE WHEN {_RAGGED} = 5 THEN 'src_ip' ELSE hostname END AS source,
  CASE {_RAGGED} WHEN 1 THEN '' WHEN 3 THEN 'a, "' || event_type || '"' WHEN 4 THEN 'disk 5" ' || event_type
                 WHEN 5 THEN 'message' ELSE event_type END AS message,
  CASE {_RAGGED} WHEN 1 THEN '' WHEN 5 THEN 'note' ELSE k END AS note,
  CASE WHEN {_RAGGED} = 6 THEN '["x1","x2"]' END AS extra,
  CASE WHEN {_RAGGED} IN (2, 5) THEN 'missing' ELSE 'parsed' END AS ts_quality, 'csv' AS log_type FROM logs""")
def q_csv_ragged(spark, d):
    """Rows that are short, wide, quoted, with an empty first cell, a stray quote, or the header's text again."""
    logs = _logs(spark, d)
    iso, et, k, host = A.iso_micros(F.col("timestamp")), F.col("event_type"), F.col("k"), F.col("hostname")
    comma = lambda *cells: F.concat_ws(",", *cells)
    kind = F.col("event_id") % 7
    text = (F.when(kind == 1, comma(iso, host)).when(kind == 2, comma(F.lit(""), host, et, k))
            .when(kind == 3, comma(iso, host, F.concat(F.lit('"a, ""'), et, F.lit('"""')), k))
            .when(kind == 4, comma(iso, host, F.concat(F.lit('disk 5" '), et), k))
            .when(kind == 5, F.lit(_RAGGED_HEADER)).when(kind == 6, comma(iso, host, et, k, F.lit("x1"), F.lit("x2")))
            .otherwise(comma(iso, host, et, k)))
    fname = F.concat(F.lit("u"), A.s("user_id"), F.lit(".csv"))
    lines = A._lines(logs, text, fname)
    header = logs.select(fname.alias("source_file")).distinct().select(
        F.lit(_RAGGED_HEADER).alias("value"), "source_file", F.lit(0).cast("long").alias("block_start"),
        F.lit(-1).cast("long").alias("line_no_key"))
    lines = header.unionByName(lines)
    parsed = ingest.parse_auto(lines, sniff_formats(lines), ingested_at=A.INGESTED_AT)
    m = F.col("metadata")
    return parsed.select(F.col("line_no_key").cast("string").alias("id"), ntz("timestamp").alias("timestamp"), "source",
                         "message", m["note"].alias("note"), m["_extra"].alias("extra"), "ts_quality", "log_type")


#: Form, Spark pattern of the rendered text, and the DuckDB expression of the time it stands for.
_TS_FORMS = [
    ("year_first_slashes", "yyyy/MM/dd HH:mm:ss", "date_trunc('second', ts)"),
    ("am_pm", "M/d/yyyy h:mm:ss a", "date_trunc('second', ts)"),
    ("rfc_2822", "EEE, d MMM yyyy HH:mm:ss '+0000'", "date_trunc('second', ts)"),
    ("apache", "dd/MMM/yyyy:HH:mm:ss '+0200'", "date_trunc('second', ts) - INTERVAL 2 HOUR"),
    ("cef_zone", "MMM dd yyyy HH:mm:ss.SSS 'UTC'", "date_trunc('millisecond', ts)"),
    ("compact", "yyyyMMdd'T'HHmmss'Z'", "date_trunc('second', ts)"),
    ("iso_offset", "yyyy-MM-dd'T'HH:mm:ss'-0530'", "date_trunc('second', ts) + INTERVAL 330 MINUTE"),
    ("day_first", "d.M.yyyy HH:mm", "date_trunc('minute', ts)"),
    ("named_month", "MMMM d, yyyy HH:mm", "date_trunc('minute', ts)"),
    ("date_only", "d MMM yyyy", "date_trunc('day', ts)"),
]


@register("timestamp_forms", " UNION ALL ".join(
    f"SELECT event_id, '{name}' AS form, CAST({sql} AS TIMESTAMP) AS parsed, 'parsed' AS quality FROM events"
    + (" WHERE day(ts) > 12" if name == "day_first" else "") for name, _, sql in _TS_FORMS))
def q_timestamp_forms(spark, d):
    """event times written in each form and parsed back (day-first numbers only where they cannot be month-first)."""
    events = A.spread(A.table(spark, d, "events").select("event_id", "ts"))
    ts = F.col("ts").cast("timestamp")
    forms = F.array(*[F.struct(F.lit(name).alias("form"), F.date_format(ts, pattern).alias("text"))
                      for name, pattern, _ in _TS_FORMS])
    rows = events.select("event_id", ts.alias("ts"), F.inline(forms)).where("form <> 'day_first' OR day(ts) > 12")
    from sieveline.functions.timeparse import with_parsed_timestamp
    out = with_parsed_timestamp(rows, "text", "p")
    return out.select("event_id", "form", ntz("p.ts").alias("parsed"), F.col("p.quality").alias("quality"))


@register("json_roundtrip", W(LOGS_CTE) + """
SELECT id, "timestamp", hostname AS source, '' AS hostname, severity, message, 'json' AS log_type,
       'parsed' AS ts_quality, CAST(user_id AS VARCHAR) AS "user" FROM logs""")
def q_json_roundtrip(spark, d):
    return _rt_cols(_parsed(spark, d, "jsonl"), [F.col("metadata")["user"].alias("user")])


@register("windows_roundtrip", W(LOGS_CTE) + """
SELECT id, "timestamp", source, hostname, CASE WHEN severity = 'low' THEN 'info' ELSE severity END AS severity,
       message, 'windows_event' AS log_type, 'parsed' AS ts_quality,
       CASE event_type WHEN 'error' THEN '4625' WHEN 'purchase' THEN '4624' WHEN 'signup' THEN '4720'
                       WHEN 'click' THEN '5157' ELSE '4663' END AS event_id FROM logs""")
def q_windows_roundtrip(spark, d):
    # One single-object JSON document per event: detected as a Windows
    # document and exploded in place.
    logs = _logs(spark, d)
    lines = A._lines(logs, A.windows_text(logs), F.concat(F.lit("win-"), F.col("id")), F.lit(0))
    lines = lines.withColumn("line_no_key", F.lit(0).cast("long"))
    formats = sniff_formats(lines)
    parsed = ingest.parse_auto(lines, formats, year=A.YEAR, ingested_at=A.INGESTED_AT)
    return parsed.select(F.regexp_replace("source_file", "^win-", "").alias("id"), ntz("timestamp").alias("timestamp"),
                         "source", "hostname", "severity", "message", "log_type", "ts_quality",
                         F.col("metadata")["event_id"].alias("event_id"))


_MIXED_TYPE_SQL = ("CASE user_id % 6 WHEN 0 THEN 'cef' WHEN 1 THEN 'syslog' WHEN 2 THEN 'syslog' WHEN 3 THEN 'csv' "
                   "ELSE 'json' END")


def _mixed(spark, d):
    logs = _logs(spark, d)
    lines = A.render_mixed(logs)
    return lines, sniff_formats(lines)


@register("sniff_formats", W(LOGS_CTE) + f"""
SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS source_file, {_MIXED_TYPE_SQL} AS log_type FROM logs""")
def q_sniff_formats(spark, d):
    _, formats = _mixed(spark, d)
    return formats.select("source_file", "log_type")


_REPORT_SQL = W(LOGS_CTE) + f"""
SELECT 'u' || CAST(user_id AS VARCHAR) AS source_file, {_MIXED_TYPE_SQL} AS log_type,
  count(*) + CASE WHEN user_id % 6 = 3 THEN 1 ELSE 0 END AS total_lines,
  count(*) FILTER (WHERE NOT (user_id % 6 = 0 AND event_type = 'view')) AS parsed,
  count(*) FILTER (WHERE user_id % 6 = 0 AND event_type = 'view') + CASE WHEN user_id % 6 = 3 THEN 1 ELSE 0 END
    AS failed,
  count(*) FILTER (WHERE user_id % 6 = 0 AND event_type = 'view') AS rejected
FROM logs GROUP BY user_id"""


@register("ingest_report", _REPORT_SQL)
def q_ingest_report(spark, d):
    lines, formats = _mixed(spark, d)
    logs = ingest.parse_auto(lines, formats, year=A.YEAR, ingested_at=A.INGESTED_AT)
    rep = ingest.ingest_report(lines, formats, logs)
    return rep.select("source_file", "log_type", "total_lines", "parsed", "failed", "rejected")


@register("ingest_totals", "SELECT 'unknown' AS log_type, CAST(sum(total_lines) AS BIGINT) AS total_lines, "
          "CAST(sum(parsed) AS BIGINT) AS parsed, CAST(sum(failed) AS BIGINT) AS failed, "
          "CAST(sum(rejected) AS BIGINT) AS rejected FROM (" + _REPORT_SQL + ")")
def q_ingest_totals(spark, d):
    lines, formats = _mixed(spark, d)
    logs = ingest.parse_auto(lines, formats, year=A.YEAR, ingested_at=A.INGESTED_AT)
    tot = ingest.summarize_report(ingest.ingest_report(lines, formats, logs))
    return tot.select("log_type", "total_lines", "parsed", "failed", "rejected")


@register("rejects", W(LOGS_CTE) + """
SELECT 'u' || CAST(user_id AS VARCHAR) AS source_file, event_id AS line_no_key, 'view event ' || id AS value
FROM logs WHERE user_id % 6 = 0 AND event_type = 'view'""")
def q_rejects(spark, d):
    lines, formats = _mixed(spark, d)
    logs = ingest.parse_auto(lines, formats, year=A.YEAR, ingested_at=A.INGESTED_AT)
    return ingest.rejects(lines, formats, logs).select("source_file", "line_no_key", "value")


@register("json_array_split", W(LOGS_CTE) + """
SELECT 'u' || CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place,
       "timestamp", hostname AS source, severity, message, k FROM logs""")
def q_json_array_split(spark, d):
    """N5 on documents that are one array each, read by many tasks and split at their elements."""
    from sieveline.sources import jsonlog, jsonsplit
    from sieveline.sources.scratch import scratch_path
    logs = _logs(spark, d)
    w = Window.partitionBy("user_id").orderBy("event_id")
    text = F.concat(F.when(F.row_number().over(w) == 1, F.lit("[")).otherwise(F.lit(",")), A.jsonl_text(logs),
                    F.when(F.lead("event_id").over(w).isNull(), F.lit("]")).otherwise(F.lit("")))
    path = scratch_path(spark, "arrays")
    (logs.select("user_id", "event_id", text.alias("value")).repartition("user_id").sortWithinPartitions("user_id", "event_id")
     .select("user_id", "value").write.partitionBy("user_id").text(path))
    rows = jsonsplit.read_arrays(spark, path)
    out = jsonlog.normalize_json(rows, ingested_at=A.INGESTED_AT)
    file = F.concat(F.lit("u"), F.regexp_extract("source_file", "user_id=([0-9]+)", 1))
    return out.select(file.alias("file"), F.col("line_no_key").alias("place"), ntz("timestamp").alias("timestamp"), "source",
                      "severity", "message", F.col("metadata")["k"].alias("k"))


@register("parsed_ids", None)
def q_parsed_ids(spark, d):
    """Deterministic ids over the mixed fixture (no SQL twin: md5 of
    content and occurrence rank)."""
    lines, formats = _mixed(spark, d)
    logs = ingest.assign_ids(ingest.parse_auto(lines, formats, year=A.YEAR, ingested_at=A.INGESTED_AT))
    return logs.select("id", "source_file", "log_type", "severity")


# --- anomalies (A8-A11, W1-W3, D1-D4) -----------------------------------------------------------

@register("bucket_zscores", W(LOGS_CTE, _BUCKETS_CTE) + """
SELECT key, bucket, count, log_id, n_buckets, round(mean, 6) AS mean, round(std, 6) AS std,
       round(zscore, 6) AS zscore FROM zz""")
def q_bucket_zscores(spark, d):
    logs = _logs(spark, d)
    z = anomalies.with_newest_id(logs, anomalies.bucket_zscores(logs))
    return z.select("key", ntz("bucket").alias("bucket"), "count", "log_id", "n_buckets", r6("mean").alias("mean"),
                    r6("std").alias("std"), r6("zscore").alias("zscore"))


@register("bucket_zscores_filled", W(LOGS_CTE) + """
, b AS (SELECT source AS key, time_bucket(INTERVAL 10 MINUTE, "timestamp") AS bucket, count(*) AS count FROM logs GROUP BY ALL),
calendar AS (SELECT key, unnest(generate_series(min(bucket), max(bucket), INTERVAL 10 MINUTE)) AS bucket FROM b GROUP BY key),
f AS (SELECT c.key, c.bucket, coalesce(b.count, 0) AS count FROM calendar c LEFT JOIN b ON b.key = c.key AND b.bucket = c.bucket),
z AS (SELECT *, count(*) OVER w AS n_buckets, avg(count) OVER w AS mean, stddev_pop(count) OVER w AS std
      FROM f WINDOW w AS (PARTITION BY key))
SELECT key, bucket, count, n_buckets, round(mean, 6) AS mean, round(std, 6) AS std,
       round(CASE WHEN std > 0 THEN (count - mean) / std END, 6) AS zscore FROM z WHERE count > 0""")
def q_bucket_zscores_filled(spark, d):
    """Q18: buckets without logs count as zeros."""
    z = anomalies.bucket_zscores(_logs(spark, d), fill_empty=True)
    return z.select("key", ntz("bucket").alias("bucket"), "count", "n_buckets", r6("mean").alias("mean"),
                    r6("std").alias("std"), r6("zscore").alias("zscore"))


@register("frequency_anomalies", W(LOGS_CTE, _BUCKETS_CTE) + _FREQ_SQL)
def q_frequency_anomalies(spark, d):
    fa = anomalies.frequency_anomalies(_logs(spark, d))
    return fa.select("log_id", F.regexp_extract("explanation", "source '([^']*)'", 1).alias("key"),
                     r6("score").alias("score"), "method")


def _escalation_sql(by: str | None) -> str:
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by}, " if by else ""
    using = f"JOIN t USING ({by})" if by else "CROSS JOIN t"
    return W(LOGS_CTE) + f"""
, r AS (SELECT {key}id, severity, row_number() OVER ({part} ORDER BY "timestamp", id) - 1 AS rk,
               count(*) OVER ({part}) AS n FROM logs),
h AS (SELECT *, rk >= n // 2 AS late FROM r),
s AS (SELECT {key}count(*) AS n, count(*) FILTER (WHERE NOT late) AS early_n, count(*) FILTER (WHERE late) AS late_n,
             count(*) FILTER (WHERE NOT late AND severity IN ('critical', 'high')) AS early_high,
             count(*) FILTER (WHERE late AND severity IN ('critical', 'high')) AS late_high
      FROM h {"GROUP BY " + by if by else ""}),
t AS (SELECT *, CAST(early_high AS DOUBLE) / greatest(early_n, 1) AS early_rate,
             CAST(late_high AS DOUBLE) / greatest(late_n, 1) AS late_rate FROM s
      WHERE n >= 10 AND CAST(late_high AS DOUBLE) / greatest(late_n, 1) > 2 * CAST(early_high AS DOUBLE) / greatest(early_n, 1)
        AND late_high >= 3)
SELECT {"h." + by + ", " if by else ""}h.id AS log_id, round(least((late_rate - early_rate) * 2, 1.0), 6) AS score
FROM h {using.replace("CROSS JOIN t", ", t")} WHERE h.late AND h.severity IN ('critical', 'high')""".replace(
        "WITH logs AS", "WITH logs AS", 1)


@register("severity_escalation_by_user", _escalation_sql("user_id"))
def q_severity_escalation_by_user(spark, d):
    logs = _logs(spark, d)
    esc = anomalies.severity_escalation(logs, by=["user_id"])
    return esc.join(logs.select(F.col("id").alias("log_id"), "user_id"), "log_id") \
              .select("user_id", "log_id", r6("score").alias("score"))


@register("severity_escalation", _escalation_sql(None))
def q_severity_escalation(spark, d):
    esc = anomalies.severity_escalation(_logs(spark, d))
    return esc.select("log_id", r6("score").alias("score"))


_CENTROID_CTE = """c AS (SELECT list(v ORDER BY pos) AS centroid FROM
    (SELECT pos, avg(x) AS v FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x,
                                          generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)),
dist AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_distance(CAST(embedding AS DOUBLE[]), c.centroid) AS distance
         FROM embeddings, c)"""
OUTLIER_THRESHOLD = 1.005


@register("vector_centroid", """
SELECT pos - 1 AS dim, round(avg(x), 6) AS value FROM
  (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
GROUP BY pos""")
def q_vector_centroid(spark, d):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    e = _emb(spark, d)
    c = e.agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))).alias("c"))
    return c.select(F.posexplode("c").alias("dim", "value")).select(F.col("dim").cast("long"), r6("value").alias("value"))


@register("vector_outliers", W(_CENTROID_CTE) + f"""
SELECT id, round(distance, 6) AS distance FROM dist WHERE distance > {OUTLIER_THRESHOLD}""")
def q_vector_outliers(spark, d):
    out = anomalies.vector_outliers(_emb(spark, d), OUTLIER_THRESHOLD)
    return out.select("id", r6("distance").alias("distance"))


@register("anomaly_explanations", _escalation_sql("user_id").split("SELECT h.user_id", 1)[0].rstrip()
          + f""",
{_BUCKETS_CTE},
{_CENTROID_CTE}
SELECT log_id, 'frequency_zscore' AS method, printf('Unusual frequency spike from source ''%s'': %d events in bucket (mean=%.1f, z-score=%.2f)',
       key, count, mean, zscore) AS explanation FROM zz WHERE {_FREQ_WHERE}
UNION ALL SELECT id, 'vector_distance', printf('Log embedding is unusually distant from cluster centroid (distance=%.3f)', distance)
FROM dist WHERE distance > {OUTLIER_THRESHOLD} AND id IN (SELECT id FROM logs)
UNION ALL SELECT h.id, 'severity_escalation', printf('Severity escalation detected: high/critical rate jumped from %.1f%% to %.1f%% in recent window',
       early_rate * 100, late_rate * 100)
FROM h JOIN t USING (user_id) WHERE h.late AND h.severity IN ('critical', 'high')""")
def q_anomaly_explanations(spark, d):
    """the whole explanation of every detector's results."""
    logs = _logs(spark, d)
    found = [anomalies.frequency_anomalies(logs), anomalies.vector_anomalies(logs, _emb(spark, d), OUTLIER_THRESHOLD),
             anomalies.severity_escalation(logs, by=["user_id"])]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("log_id", "method", "explanation")


@register("detect_anomalies", W(LOGS_CTE.replace("FROM events)", "FROM events WHERE ts BETWEEN "
                                                 "TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00')"),
                                _BUCKETS_CTE, _CENTROID_CTE) + f"""
, res AS (
  SELECT id AS log_id, least(distance / 3.0, 1.0) AS score, 'vector_distance' AS method, 0 AS method_order
  FROM dist WHERE distance > {OUTLIER_THRESHOLD} AND id IN (SELECT id FROM logs)
  UNION ALL
  SELECT log_id, least(zscore / 5.0, 1.0), 'frequency_zscore', 1 FROM zz
  WHERE (SELECT count(*) FROM logs) >= 5 AND n_buckets >= 3 AND zscore > 2.0),
best AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY score DESC, method_order) AS rn FROM res)
SELECT log_id, round(score, 6) AS score, method FROM best WHERE rn = 1""")
def q_detect_anomalies(spark, d):
    out = anomalies.detect_anomalies(_logs(spark, d), as_of=A.AS_OF, minutes=30 * 24 * 60, embeddings=_emb(spark, d),
                                     vector_threshold=OUTLIER_THRESHOLD)
    return out.select("log_id", r6("score").alias("score"), "method")


@register("knn_cosine", """
WITH x AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos
           FROM embeddings),
c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(v) AS m FROM x GROUP BY label, pos)
      GROUP BY label),
dd AS (SELECT e.label, CAST(e.vec_id AS VARCHAR) AS id,
              1.0 - list_dot_product(CAST(e.embedding AS DOUBLE[]), c.centroid)
                    / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))
                       * sqrt(list_dot_product(c.centroid, c.centroid))) AS distance
       FROM embeddings e JOIN c ON e.label = c.label),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_num) AS rank
       FROM (SELECT *, CAST(id AS BIGINT) AS vec_num FROM dd))
SELECT label, id, rank, round(distance, 6) AS distance FROM rk WHERE rank <= 5""")
def q_knn_cosine(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    out = vectors.knn_to_group_centroid(e, "label", k=5, id_col="vec_id")
    return out.select("label", F.col("vec_id").cast("string").alias("id"), F.col("rank").cast("long"),
                      r6("distance").alias("distance"))


@register("knn_global", """
WITH x AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT list(m ORDER BY pos) AS centroid FROM (SELECT pos, avg(v) AS m FROM x GROUP BY pos)),
dd AS (SELECT vec_id, 1.0 - list_dot_product(CAST(e.embedding AS DOUBLE[]), c.centroid)
                    / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))
                       * sqrt(list_dot_product(c.centroid, c.centroid))) AS distance FROM embeddings e, c)
SELECT CAST(vec_id AS VARCHAR) AS id, round(distance, 6) AS distance FROM dd ORDER BY distance, vec_id LIMIT 10""")
def q_knn_global(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", "embedding")
    out = vectors.knn(e, anomalies.centroid(e), k=10, id_col="vec_id")
    return out.select(F.col("vec_id").cast("string").alias("id"), r6("distance").alias("distance"))


# --- incidents and reports (D5, D6, L6, L7, A12, A13) -------------------------------------------

_HOSTS_CTE = """hh AS (SELECT DISTINCT hostname AS key, h AS host FROM logs, (SELECT unnest([hostname, source]) AS h)
             WHERE h IS NOT NULL AND h <> ''),
hosts AS (SELECT key, count(*) AS host_count,
                 string_agg(host, ', ' ORDER BY host) FILTER (WHERE rn <= 20) AS affected_hosts
          FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY host) AS rn FROM hh) GROUP BY key)"""


@register("incident_summary", W(LOGS_CTE) + """
, hh AS (SELECT DISTINCT hostname AS key, unnest([hostname, source]) AS host FROM logs),
hosts AS (SELECT key, count(*) AS host_count,
                 string_agg(host, ', ' ORDER BY host) FILTER (WHERE rn <= 20) AS affected_hosts
          FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY host) AS rn FROM hh
                WHERE host IS NOT NULL AND host <> '') GROUP BY key),
base AS (SELECT hostname AS key, count(*) AS log_count,
                max(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3
                                  WHEN 'critical' THEN 4 END) AS rk FROM logs GROUP BY hostname)
SELECT base.key AS hostname,
       printf('Security incident involving %d host(s) — %d events', coalesce(host_count, 0), log_count) AS title,
       CASE rk WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity,
       coalesce(affected_hosts, '') AS affected_hosts, CAST(coalesce(host_count, 0) AS BIGINT) AS host_count, log_count,
       'Review the flagged log entries and investigate affected hosts.' AS recommendation
FROM base LEFT JOIN hosts ON base.key = hosts.key""")
def q_incident_summary(spark, d):
    out = incidents.incident_summary(_logs(spark, d), by=["hostname"])
    return out.drop("timeline")


@register("incident_timeline", W(LOGS_CTE) + f"""
SELECT hostname, rank, time, event FROM (
  SELECT hostname, row_number() OVER (PARTITION BY hostname ORDER BY "timestamp", id) AS rank,
         {_ISO_SQL} AS time, '[' || upper(severity) || '] ' || substr(message, 1, 100) AS event FROM logs)
WHERE rank <= 10""")
def q_incident_timeline(spark, d):
    out = incidents.incident_timeline(_logs(spark, d), by=["hostname"])
    return out.select("hostname", F.col("rank").cast("long"), "time", "event")


@register("security_report", W(LOGS_CTE) + """
, sb AS (SELECT hostname AS key, sum(n) AS total,
                string_agg(printf('  - %s: %d', severity, n), chr(10) ORDER BY severity) AS stats
         FROM (SELECT hostname, severity, count(*) AS n FROM logs GROUP BY ALL) GROUP BY hostname),
hh AS (SELECT DISTINCT hostname AS key, unnest([hostname, source]) AS host FROM logs),
hosts AS (SELECT key, string_agg(host, ', ' ORDER BY host) FILTER (WHERE rn <= 20) AS affected_hosts
          FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY host) AS rn FROM hh
                WHERE host IS NOT NULL AND host <> '') GROUP BY key)
SELECT sb.key AS hostname, CAST(total AS BIGINT) AS log_count, stats AS severity_breakdown,
       coalesce(affected_hosts, '') AS affected_hosts,
       '# Security Report (auto-generated)' || chr(10) || chr(10) || '**Total logs:** ' || CAST(CAST(total AS BIGINT) AS VARCHAR)
       || chr(10) || chr(10) || '**Severity breakdown:**' || chr(10) || stats || chr(10) || chr(10)
       || '**Affected hosts:** ' || coalesce(affected_hosts, '') || chr(10) || chr(10)
       || '*Note: LLM summarization unavailable — this is a basic auto-generated report.*' AS report
FROM sb LEFT JOIN hosts ON sb.key = hosts.key""")
def q_security_report(spark, d):
    return incidents.security_report(_logs(spark, d), by=["hostname"])


@register("incident_digest", W(LOGS_CTE) + f"""
SELECT hostname, printf('%d lines, %d characters, %d denied', count(*), CAST(sum(length(line)) AS BIGINT),
                        count(*) FILTER (WHERE contains(line, 'denied'))) AS summary
FROM (SELECT hostname, '[' || {_ISO_SQL} || '] [' || upper(severity) || '] host=' || hostname || ' | ' || message AS line
      FROM logs) GROUP BY hostname""")
def q_incident_digest(spark, d):
    """D5 by a user's functions, in bounded chunks that are merged in rounds."""
    def digest(lines):
        return f"{len(lines)} lines, {sum(map(len, lines))} characters, {sum('denied' in x for x in lines)} denied"

    def together(parts):
        numbers = [[int(w.split()[0]) for w in p.split(", ")] for p in parts]
        n, chars, denied = map(sum, zip(*numbers, strict=True))
        return f"{n} lines, {chars} characters, {denied} denied"
    return incidents.summarize_incidents(_logs(spark, d), digest, together, by=["hostname"], chunk_rows=100, fan_in=5)


# --- saved questions (D7, J8, F13-F16, A14) -------------------------------------------------------

# Saved questions run next to the user turns of ``conversations``.
SAVED_QUESTIONS = [
    ("q1", "failed password invalid user"),
    ("q2", "critical brute force attack"),
    ("q3", "show me connection denied by firewall"),
    ("q4", "last hour session opened"),
    ("q5", "what happened on 198.51.100.7"),
    ("q6", "list possible brute force attack failed password"),
    ("q7", "low traffic payment token"),
    ("q8", "today new account created"),
]


def _questions(spark, d) -> DataFrame:
    conv = A.table(spark, d, "conversations").where(F.col("role") == "user") \
        .select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
                .alias("question_id"), "text")
    saved = spark.createDataFrame(SAVED_QUESTIONS, "question_id string, text string")
    return saved.unionByName(conv)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _questions_sql() -> str:
    from sieveline.functions.text import STOP_WORDS, WORD_PATTERN
    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    sev = " ".join(f"WHEN strpos(lower(text), '{x}') > 0 THEN '{x}'" for x in
                   ["critical", "high", "medium", "low", "info"])
    return f"""questions AS (
  SELECT * FROM (VALUES {_values(SAVED_QUESTIONS)}) t(question_id, text)
  UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations WHERE role = 'user'),
hunts AS (
  SELECT question_id, text AS question, CASE {sev} END AS severity,
    CASE WHEN strpos(lower(text), 'last hour') > 0 THEN {AS_OF_SQL} - INTERVAL 1 HOUR
         WHEN strpos(lower(text), 'last 24 hours') > 0 OR strpos(lower(text), 'last day') > 0
           THEN {AS_OF_SQL} - INTERVAL 24 HOUR
         WHEN strpos(lower(text), 'today') > 0 THEN date_trunc('day', {AS_OF_SQL}) END AS start_time,
    nullif(regexp_extract(text, '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}', 0), '') AS source,
    list_filter(regexp_extract_all(lower(text), '{WORD_PATTERN}'),
                lambda w: length(w) > 2 AND NOT list_contains({stop}, w)) AS kw
  FROM questions),
hq AS (SELECT *, CASE WHEN len(kw) > 0 THEN '%' || array_to_string(kw, '%') || '%' END AS query FROM hunts),
m AS (SELECT hq.question_id, l.* FROM logs l JOIN hq ON
        (hq.query IS NULL OR l.message ILIKE '%' || hq.query || '%')
        AND (hq.source IS NULL OR l.source ILIKE '%' || hq.source || '%' OR l.hostname ILIKE '%' || hq.source || '%')
        AND (hq.start_time IS NULL OR l."timestamp" >= hq.start_time)
        AND (hq.severity IS NULL OR l.severity = hq.severity))"""


@register("hunt_filters", W(LOGS_CTE, _questions_sql()) + """
SELECT question_id, severity, start_time, source, query FROM hq""")
def q_hunt_filters(spark, d):
    h = hunts.hunt_filters(_questions(spark, d), A.AS_OF)
    return h.select("question_id", "severity", ntz("start_time").alias("start_time"), "source", "query")


@register("hunt_matches", W(LOGS_CTE, _questions_sql()) + """
SELECT question_id, id, rank FROM (
  SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY "timestamp" DESC, id) AS rank FROM m)
WHERE rank <= 50""")
def q_hunt_matches(spark, d):
    h = hunts.hunt_filters(_questions(spark, d), A.AS_OF)
    m = hunts.match_hunts(_logs(spark, d, spread=True), h, limit=50)
    return m.select("question_id", "id", F.col("rank").cast("long"))


_REPLY_HOURS = "range(0, 24 * 30, 37)"


@register("hunt_replies", W(LOGS_CTE, f"""
replies AS (SELECT 'r' || CAST(h AS VARCHAR) AS question_id, h,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (h) HOUR AS t0, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (h + 48) HOUR AS t1,
  'host-' || CAST(h % 10 AS VARCHAR) AS host, CASE WHEN h % 3 = 0 THEN 'json' WHEN h % 3 = 1 THEN 'cef' END AS kind,
  CASE WHEN h % 2 = 0 THEN 'user%u' END AS pattern, h % 5 AS skip, 3 + h % 4 AS n
  FROM (SELECT CAST(unnest({_REPLY_HOURS}) AS BIGINT) AS h)),
ranked AS (SELECT question_id, id, skip, n,
  row_number() OVER (PARTITION BY question_id ORDER BY "timestamp" DESC, id) AS rank
  FROM replies JOIN logs ON "timestamp" BETWEEN t0 AND t1 AND hostname ILIKE '%' || host || '%'
    AND (pattern IS NULL OR message ILIKE '%' || pattern || '%') AND (kind IS NULL OR kind = 'json'))""") + """
SELECT question_id, id, rank FROM ranked WHERE rank > skip AND rank <= skip + n""")
def q_hunt_replies(spark, d):
    """every key of a model reply is honoured (the logs' own log type is json, so cef replies match nothing)."""
    h = spark.range(0, 24 * 30, 37).withColumnRenamed("id", "h")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda plus: F.date_format(F.timestamp_seconds(F.unix_timestamp(start) + (F.col("h") + plus) * 3600),
                                    "yyyy-MM-dd HH:mm:ss")
    reply = F.to_json(F.struct(
        at(0).alias("start_time"), at(48).alias("end_time"), F.concat(F.lit("host-"), A.s(F.col("h") % 10)).alias("hostname"),
        F.when(F.col("h") % 3 == 0, "json").when(F.col("h") % 3 == 1, "CEF").alias("log_type"),
        F.when(F.col("h") % 2 == 0, "user%u").alias("query"), A.s(F.col("h") % 5).alias("offset"),
        A.s(F.col("h") % 4 + 3).alias("limit")))
    replies = h.select(F.concat(F.lit("r"), A.s("h")).alias("question_id"),
                       F.concat(F.lit("```json\n"), reply, F.lit("\n```")).alias("reply"))
    m = hunts.match_hunts(_logs(spark, d), hunts.filters_from_replies(replies))
    return m.select("question_id", "id", F.col("rank").cast("long").alias("rank"))


def _summary_sql(matches: str) -> str:
    return f"""
, sev AS (SELECT question_id, CAST(sum(n) AS BIGINT) AS total,
                 string_agg(printf('%d %s', n, severity), ', ' ORDER BY severity) AS sb
          FROM (SELECT question_id, severity, count(*) AS n FROM {matches} GROUP BY ALL) GROUP BY question_id),
src AS (SELECT question_id, string_agg(source, ', ' ORDER BY source) FILTER (WHERE rn <= 5) AS sources
        FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY source) AS rn
              FROM (SELECT DISTINCT question_id, source FROM {matches} WHERE source <> '')) GROUP BY question_id)
SELECT hq.question_id, coalesce(total, 0) AS total_matches, coalesce(sb, '') AS severity_breakdown,
       coalesce(sources, '') AS sources,
       CASE WHEN coalesce(total, 0) = 0 THEN 'No logs found matching: ' || hq.question
            ELSE concat_ws(' ', printf('Found %d matching log(s).', total), 'Severity breakdown: ' || sb || '.',
                           CASE WHEN sources IS NOT NULL THEN 'Sources: ' || sources || '.' END) END AS summary
FROM hq LEFT JOIN sev USING (question_id) LEFT JOIN src USING (question_id)"""


@register("hunt_summary", W(LOGS_CTE, _questions_sql()) + _summary_sql("m"))
def q_hunt_summary(spark, d):
    h = hunts.hunt_filters(_questions(spark, d), A.AS_OF)
    m = hunts.match_hunts(_logs(spark, d, spread=True), h, limit=None)
    return hunts.summarize_matches(h, m)


def _cosine_sql(a: str, b: str) -> str:
    """Cosine distance as kNN ranks by it: rounded to 12 digits, so that equal vectors tie."""
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return (f"round(1.0 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) "
            f"* sqrt(list_dot_product({b}, {b}))), 12) + 0.0")


@register("hunt_answers", W(LOGS_CTE, _questions_sql(), f"""
asked AS (SELECT question_id, [1 + length(question) % 7, 1 + length(question) % 5, 1 + length(question) % 3, 1] AS v
          FROM hq WHERE (SELECT count(*) FROM m WHERE m.question_id = hq.question_id) < 5),
known AS (SELECT id, [1 + user_id % 7, 1 + user_id % 5, 1 + event_id % 3, 1] AS v FROM logs),
near AS (SELECT question_id, id FROM (
           SELECT question_id, id, row_number() OVER (PARTITION BY question_id
                                                      ORDER BY {_cosine_sql("asked.v", "known.v")}, id) AS rank
           FROM asked, known) WHERE rank <= 20),
found AS (SELECT question_id, severity, source FROM m UNION ALL
          SELECT question_id, severity, source FROM near JOIN logs USING (id)
          WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.question_id = near.question_id AND m.id = near.id))""")
          + _summary_sql("found"))
def q_hunt_answers(spark, d):
    """D7 + U2 + A14: keyword matches and, where they are few, the 20 nearest logs; vectors by a fixed rule."""
    logs = _logs(spark, d, spread=True)
    h = hunts.hunt_filters(_questions(spark, d), A.AS_OF)

    def vector(*parts):
        return F.array(*[(F.lit(1) + p).cast("double") for p in parts], F.lit(1.0)).alias("embedding")
    n = F.length("question")
    asked = h.select("question_id", vector(n % 7, n % 5, n % 3))
    known = logs.select("id", vector(F.col("user_id") % 7, F.col("user_id") % 5, F.col("event_id") % 3))
    return hunts.answer_hunts(logs, h, asked, known)


# --- live feed and streams (J7, P10, N9, T1-T5) -------------------------------------------------------

SUBSCRIPTIONS = {"soc": ["critical", "high"], "audit": None, "ops": ["medium", "low"]}


def _subs_sql() -> str:
    from sieveline.schema import SEVERITIES
    rows = [(k, s) for k, v in SUBSCRIPTIONS.items() for s in (v or SEVERITIES)]
    return f"subs AS (SELECT * FROM (VALUES {_values(rows)}) t(subscriber, severity))"


_FAN_SQL = W(LOGS_CTE, _subs_sql()) + f"""
SELECT subscriber, id, logs.severity,
       CASE WHEN length(message) > {FEED_PREVIEW} THEN substr(message, 1, {FEED_PREVIEW}) || '...' ELSE message END
         AS preview
FROM logs JOIN subs ON logs.severity = subs.severity"""


@register("fan_out", _FAN_SQL)
def q_fan_out(spark, d):
    out = feed.fan_out(feed.feed_view(_logs(spark, d)), feed.subscriptions_table(spark, SUBSCRIPTIONS))
    return out.select("subscriber", "id", "severity", "preview")


@register("live_feed", W(LOGS_CTE) + f"""
SELECT id, "timestamp", severity, CASE WHEN length(message) > {FEED_PREVIEW}
       THEN substr(message, 1, {FEED_PREVIEW}) || '...' ELSE message END AS preview FROM logs""")
def q_live_feed(spark, d):
    out = feed.feed_view(_logs(spark, d))
    return out.select("id", ntz("timestamp").alias("timestamp"), "severity", "preview")


def _event_stream(spark, d) -> DataFrame:
    """The events table as a stream, whether it is one file or a folder of part files."""
    events = A.table(spark, d, "events")
    folder = d.rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 100)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        folder = f"{folder}/events.parquet"
    else:
        stream = stream.option("pathGlobFilter", "events.parquet")
    return A.events_as_logs(stream.parquet(folder))


def _stream_root(spark, name: str) -> str:
    """A fresh folder with an empty ``out``, so that a stream without rows gives an empty result."""
    from sieveline.sources.scratch import scratch_path
    root = scratch_path(spark, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/out")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return root


def _run_stream(spark, df: DataFrame, name: str) -> DataFrame:
    root = _stream_root(spark, name)
    feed.run_to_table(df, f"{root}/out", f"{root}/ckpt")
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def _run_updates(spark, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    root = _stream_root(spark, name)
    feed.run_updates(df, f"{root}/out", f"{root}/ckpt")
    return feed.latest_updates(spark, f"{root}/out", keys, df.schema)


@register("stream_feed", _FAN_SQL)
def q_stream_feed(spark, d):
    logs = _event_stream(spark, d)
    out = feed.fan_out(feed.feed_view(logs), feed.subscriptions_table(spark, SUBSCRIPTIONS))
    return _run_stream(spark, out.select("subscriber", "id", "severity", "preview"), "stream_feed")


@register("stream_hourly_counts", W(LOGS_CTE) + """
SELECT date_trunc('hour', "timestamp") AS hour, severity, count(*) AS count FROM logs GROUP BY 1, 2""")
def q_stream_hourly_counts(spark, d):
    counts = feed.hourly_counts_stream(_event_stream(spark, d), "10 minutes")
    out = _run_updates(spark, counts, "stream_hourly", ["hour", "severity"])
    return out.select(ntz("hour").alias("hour"), "severity", "count")


@register("stream_text_feed", W(LOGS_CTE, _subs_sql()) + f"""
SELECT subscriber, "timestamp", source, hostname, logs.severity, log_type,
       CASE WHEN length(message) > {FEED_PREVIEW} THEN substr(message, 1, {FEED_PREVIEW}) || '...' ELSE message END
         AS preview
FROM (SELECT *, 'syslog' AS log_type FROM logs) AS logs JOIN subs ON logs.severity = subs.severity""")
def q_stream_text_feed(spark, d):
    """T1 from raw text: log files are streamed, parsed and fanned out."""
    root = _stream_root(spark, "text-feed")
    A.render(_logs(spark, d), "syslog5424").select("value").write.text(f"{root}/in")
    subs = feed.subscriptions_table(spark, SUBSCRIPTIONS)
    feed.text_feed_stream(spark, f"{root}/in", subs, f"{root}/out", f"{root}/ckpt", year=A.YEAR,
                          ingested_at=A.INGESTED_AT, max_files=4).awaitTermination()
    out = spark.read.schema("subscriber string, timestamp timestamp, source string, hostname string, severity string, "
                            "log_type string, preview string").parquet(f"{root}/out")
    return out.select("subscriber", ntz("timestamp").alias("timestamp"), "source", "hostname", "severity", "log_type",
                      "preview")


@register("stream_spikes", W(LOGS_CTE) + """
, b AS (SELECT source AS key, time_bucket(INTERVAL 10 MINUTE, "timestamp") AS bucket, count(*) AS count FROM logs
        GROUP BY ALL),
z AS (SELECT *, count(*) OVER up AS n_buckets, CAST(sum(count) OVER up AS BIGINT) AS total, avg(count) OVER up AS mean,
             stddev_pop(count) OVER up AS std
      FROM b WINDOW up AS (PARTITION BY key ORDER BY bucket ROWS UNBOUNDED PRECEDING))
SELECT key, bucket, count, n_buckets, total, round(CASE WHEN std > 0 THEN (count - mean) / std END, 6) AS zscore,
       n_buckets >= 3 AND coalesce((count - mean) / nullif(std, 0), 0) > 2.0 AS spike FROM z
WHERE bucket + INTERVAL 10 MINUTE <= (SELECT max("timestamp") FROM logs) - INTERVAL 10 MINUTE""")
def q_stream_spikes(spark, d):
    """T5/D2 in the stream: every bucket is scored as the watermark closes it."""
    from sieveline.streaming import spikes
    root = _stream_root(spark, "spikes")
    scored = spikes.spike_stream(_event_stream(spark, d))
    spikes.run_spikes(scored, f"{root}/out", f"{root}/ckpt").awaitTermination()
    out = spark.read.schema(scored.schema).parquet(f"{root}/out")
    return out.select("key", ntz("bucket").alias("bucket"), "count", "n_buckets", "total", r6("zscore").alias("zscore"),
                      F.coalesce(spikes.is_spike(), F.lit(False)).alias("spike"))


# --- embedding (V1) and whole-input incident ------------------------------------------------------

@register("embed_logs", None)
def q_embed_logs(spark, d):
    """V1/J5 with the offline hashing embedder: every distinct embed text is
    embedded once and joined back (no SQL twin for the hashing)."""
    emb = vectors.embed_logs(_logs(spark, d))
    from sieveline.functions.vectors import norm
    return emb.select("id", F.size("embedding").cast("long").alias("dim"), r6(norm(F.col("embedding"))).alias("norm"),
                      "document")


@register("embed_logs_idf", None)
def q_embed_logs_idf(spark, d):
    """V1 with IDF: weights fitted on the logs before the last day and stored, then used for all (a brute-force test
    stands for the SQL that hashing has not)."""
    from sieveline.functions.vectors import norm
    from sieveline.sources.scratch import scratch_path
    logs = _logs(spark, d)
    path = scratch_path(spark, "idf")
    old = logs.where(F.col("timestamp") < F.lit(A.AS_OF - timedelta(days=1)).cast("timestamp"))
    vectors.fit_idf(vectors.log_embed_text(old).select(F.col("embed_text").alias("text")), path)
    emb = vectors.embed_logs(logs, vectors.idf_embedder(path))
    return emb.select("id", F.size("embedding").cast("long").alias("dim"), r6(norm(F.col("embedding"))).alias("norm"))


@register("incident_summary_all", W(LOGS_CTE) + """
, hh AS (SELECT DISTINCT unnest([hostname, source]) AS host FROM logs),
hosts AS (SELECT count(*) AS host_count,
                 string_agg(host, ', ' ORDER BY host) FILTER (WHERE rn <= 20) AS affected_hosts
          FROM (SELECT *, row_number() OVER (ORDER BY host) AS rn FROM hh WHERE host IS NOT NULL AND host <> ''))
SELECT 'all' AS incident,
       printf('Security incident involving %d host(s) — %d events', host_count, (SELECT count(*) FROM logs)) AS title,
       (SELECT CASE max(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3
                                       WHEN 'critical' THEN 4 END)
               WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END
        FROM logs) AS severity,
       affected_hosts, CAST(host_count AS BIGINT) AS host_count, (SELECT count(*) FROM logs) AS log_count,
       'Review the flagged log entries and investigate affected hosts.' AS recommendation
FROM hosts""")
def q_incident_summary_all(spark, d):
    return incidents.incident_summary(_logs(spark, d)).drop("timeline")


@register("knn_label_centroids", """
WITH x AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(v) AS m FROM x GROUP BY label, pos)
      GROUP BY label),
dd AS (SELECT CAST(c.label AS VARCHAR) AS query_id, CAST(e.vec_id AS VARCHAR) AS id, e.vec_id,
              1.0 - list_dot_product(CAST(e.embedding AS DOUBLE[]), c.centroid)
                    / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))
                       * sqrt(list_dot_product(c.centroid, c.centroid))) AS distance
       FROM embeddings e, c),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dd)
SELECT query_id, id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM rk WHERE rank <= 5""")
def q_knn_label_centroids(spark, d):
    """V2 for many queries: the 5 vectors nearest to each label centroid,
    searched over all vectors (not only the label's)."""
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")
    cents = vectors.group_centroids(e, "label").select(F.col("label").cast("string").alias("query_id"),
                                                        F.col("centroid").alias("embedding"))
    out = vectors.knn_many(e, cents, k=5)
    return out.select("query_id", "id", F.col("rank").cast("long"), r6("distance").alias("distance"))


@register("knn_batch", f"""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
dd AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(e.vec_id AS VARCHAR) AS id,
              {_cosine_sql("q.embedding", "e.embedding")} AS distance FROM q, embeddings e),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dd)
SELECT query_id, id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM rk WHERE rank <= 10""")
def q_knn_batch(spark, d):
    """V2 for a whole set of questions, exact: the 10 nearest vectors of every hundredth one."""
    e = _emb(spark, d)
    out = vectors.knn_many(e, e.where(F.col("id").cast("long") % 100 == 0).withColumnRenamed("id", "query_id"), k=10)
    return out.select("query_id", "id", F.col("rank").cast("long"), r6("distance").alias("distance"))


@register("knn_index", None)
def q_knn_index(spark, d):
    """V2 through the index of cells, the questions of ``knn_batch`` (approximate: tests measure its recall)."""
    from sieveline.operators import vector_index
    e = _emb(spark, d)
    index = vector_index.build_index(e)
    out = vector_index.search(index, e.where(F.col("id").cast("long") % 100 == 0).withColumnRenamed("id", "query_id"), 10)
    return out.select("query_id", "id", F.col("rank").cast("long"), r6("distance").alias("distance"))


@register("stored_vectors", """
WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, label, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings)
SELECT 1::BIGINT AS version, id, dim, 'original' AS document FROM v UNION ALL
SELECT 3, id, dim, CASE WHEN label = 0 THEN 'relabelled' ELSE 'original' END FROM v WHERE vec_id % 10 <> 3""")
def q_stored_vectors(spark, d):
    """K2/K3 on a stored table of vectors: three commits, the first and the last version read."""
    from sieveline.sources import snapshots
    from sieveline.sources.scratch import scratch_path
    table = snapshots.vector_table(spark, scratch_path(spark, "vectors"))
    e = _emb(spark, d)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id").cast("long") * 3600)
    rows = e.select("id", "embedding", "label", F.lit("original").alias("document"), F.lit("info").alias("severity"),
                    F.lit("").alias("source"), F.lit("").alias("hostname"), at.alias("timestamp"),
                    F.lit("json").alias("log_type"))
    snapshots.store_vectors(table, rows)
    new = rows.where("label = 0").withColumn("document", F.lit("relabelled"))
    snapshots.store_vectors(table, new.withColumn("timestamp", F.expr("timestamp + INTERVAL 1 DAY")))
    table.delete(e.where("cast(id as long) % 10 = 3").select("id"))
    both = [table.read(n).withColumn("version", F.lit(n).cast("long")) for n in (1, 3)]
    return both[0].union(both[1]).select("version", "id", F.size("embedding").cast("long").alias("dim"), "document")


@register("hunt_semantic", None)
def q_hunt_semantic(spark, d):
    """D7 + U2 with the offline hashing embedder for questions and logs
    (no SQL twin for the hashing): keyword hits, then semantic hits for
    questions with fewer than 5 keyword hits."""
    from sieveline.sources.scratch import written
    logs = written(_logs(spark, d, spread=True)
                   .select("id", "timestamp", "source", "hostname", "severity", "message", "log_type"), "hunt-logs")
    h = hunts.hunt_filters(_questions(spark, d), A.AS_OF)
    embed = vectors.hashing_embedder()
    log_vecs = vectors.embed_logs(logs, embed, dedupe=False).select("id", "embedding")
    q_vecs = embed(h.select(F.col("question").alias("text")).distinct()) \
        .join(h.select("question_id", F.col("question").alias("text")), "text").select("question_id", "embedding")
    out = hunts.match_hunts_with_semantic(logs, h, q_vecs, log_vecs, limit=100, columns=["id", "timestamp"])
    return out.select("question_id", "id", F.col("rank").cast("long"), "origin")


# --- remaining small operators (A17, W5, P9, K2, K1+K5, T4) -----------------------------------------

@register("vector_count", "SELECT count(*) AS vector_count FROM embeddings")
def q_vector_count(spark, d):
    return vectors.vector_count(_emb(spark, d))


@register("feed_last_500", W(LOGS_CTE) + """
SELECT id, "timestamp", severity FROM logs ORDER BY "timestamp" DESC, id LIMIT 500""")
def q_feed_last_500(spark, d):
    return feed.last_n(_logs(spark, d), 500).select("id", ntz("timestamp").alias("timestamp"), "severity")


@register("knn_severity", W(LOGS_CTE) + """
, x AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT list(m ORDER BY pos) AS centroid FROM (SELECT pos, avg(v) AS m FROM x GROUP BY pos)),
lv AS (SELECT CAST(e.vec_id AS VARCHAR) AS id, e.embedding, l.severity FROM embeddings e
       JOIN logs l ON CAST(e.vec_id AS VARCHAR) = l.id),
dd AS (SELECT id, 1.0 - list_dot_product(CAST(lv.embedding AS DOUBLE[]), c.centroid)
                    / (sqrt(list_dot_product(CAST(lv.embedding AS DOUBLE[]), CAST(lv.embedding AS DOUBLE[])))
                       * sqrt(list_dot_product(c.centroid, c.centroid))) AS distance FROM lv, c WHERE severity = 'high')
SELECT id, round(distance, 6) AS distance FROM dd ORDER BY distance, id LIMIT 10""")
def q_knn_severity(spark, d):
    """V2 + P9: vectors of logs (embeddings keyed by log id) nearest to the
    overall centroid, only high-severity logs."""
    e = _emb(spark, d)
    lv = e.join(_logs(spark, d).select("id", "severity"), "id")
    out = vectors.knn(lv, anomalies.centroid(e), k=10, severity="high")
    return out.select("id", r6("distance").alias("distance"))


@register("upsert_embeddings", """
SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label = 0 THEN 'relabelled' ELSE 'original' END AS note
FROM embeddings""")
def q_upsert_embeddings(spark, d):
    e = _emb(spark, d).withColumn("note", F.lit("original")).withColumn("timestamp", F.lit(A.INGESTED_AT).cast("timestamp"))
    new = e.where(F.col("label") == 0).withColumn("note", F.lit("relabelled")) \
           .withColumn("timestamp", F.lit(A.INGESTED_AT + timedelta(days=1)).cast("timestamp"))
    return sinks.upsert_embeddings(e, new).select("id", "note")


@register("stored_logs", W(LOGS_CTE) + f"SELECT {SEL_LOG}, CAST(CAST(\"timestamp\" AS DATE) AS VARCHAR) AS event_date FROM logs")
def q_stored_logs(spark, d):
    """K1 write (date-partitioned Parquet under the shared checkpoint folder)
    then K5 read back with the fixed schema."""
    import uuid
    from sieveline.schema import LOG_COLUMNS
    from sieveline.session import checkpoint_root
    path = f"{checkpoint_root(spark)}/stored-logs-{uuid.uuid4().hex}"
    sinks.write_logs(_logs(spark, d).select(*LOG_COLUMNS), path)
    back = sinks.read_logs(spark, path).withColumn("event_date", F.col("event_date").cast("string"))
    return _out(back, LOG_OUT + ["event_date"])


def _stored(spark, d) -> tuple[DataFrame, str]:
    """Events written as a stored table under the shared folder."""
    import uuid
    from sieveline.schema import LOG_COLUMNS
    from sieveline.session import checkpoint_root
    path = f"{checkpoint_root(spark)}/stored-logs-{uuid.uuid4().hex}"
    logs = _logs(spark, d).select(*LOG_COLUMNS)
    sinks.write_logs(logs, path)
    return logs, path


@register("stored_upsert", W(LOGS_CTE) + """
SELECT id, CASE WHEN event_type = 'error' THEN "timestamp" + INTERVAL 3 DAY ELSE "timestamp" END AS "timestamp",
  CASE WHEN event_type = 'error' THEN 'REVIEWED ' || message ELSE message END AS message FROM logs""")
def q_stored_upsert(spark, d):
    """K1 on a stored table: error events are replaced by versions that lie three days later; the batch comes twice."""
    logs, path = _stored(spark, d)
    new = (logs.where(F.col("severity").isin("critical", "high"))
           .withColumn("message", F.concat(F.lit("REVIEWED "), F.col("message")))
           .withColumn("timestamp", F.expr("timestamp + INTERVAL 3 DAY")).withColumn("event_date", F.to_date("timestamp"))
           .withColumn("ingested_at", F.lit(A.INGESTED_AT + timedelta(days=1)).cast("timestamp")))
    sinks.upsert_stored(spark, new, path)
    sinks.upsert_stored(spark, new, path)
    return _out(sinks.read_logs(spark, path), ["id", "timestamp", "message"])


@register("stored_delete", W(LOGS_CTE) + f"""
SELECT {SEL_LOG}, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS event_date FROM logs
WHERE event_type <> 'click' AND CAST("timestamp" AS DATE) <> DATE '2024-01-10'""")
def q_stored_delete(spark, d):
    """K3 on a stored table: one event type and one whole day go, and the emptied day with them."""
    logs, path = _stored(spark, d)
    events = A.table(spark, d, "events")
    sinks.delete_stored(spark, events.where("event_type = 'click' OR to_date(ts) = DATE'2024-01-10'"), path, "event_id")
    back = sinks.read_logs(spark, path).withColumn("event_date", F.col("event_date").cast("string"))
    return _out(back, LOG_OUT + ["event_date"])


@register("stream_dedupe", W(LOGS_CTE) + 'SELECT id, "timestamp", severity FROM logs')
def q_stream_dedupe(spark, d):
    """T4: the event stream read twice (every id arrives two times) and
    de-duplicated on id within the watermark."""
    s = _event_stream(spark, d)
    twice = s.unionByName(_event_stream(spark, d))
    out = feed.dedupe_stream(twice).select("id", "timestamp", "severity")
    back = _run_stream(spark, out, "stream_dedupe")
    return back.select("id", ntz("timestamp").alias("timestamp"), "severity")


@register("stream_bucket_zscores", W(LOGS_CTE) + """
, b AS (SELECT source AS key, time_bucket(INTERVAL 10 MINUTE, "timestamp") AS bucket, count(*) AS count FROM logs
        GROUP BY ALL),
z AS (SELECT *, count(*) OVER (PARTITION BY key) AS n_buckets, avg(count) OVER (PARTITION BY key) AS mean,
             stddev_pop(count) OVER (PARTITION BY key) AS std FROM b)
SELECT key, bucket, count, n_buckets, round(CASE WHEN std <> 0 THEN (count - mean) / std END, 6) AS zscore FROM z""")
def q_stream_bucket_zscores(spark, d):
    """T5: 10-minute counts per source kept by a watermarked stream, then
    z-scores over the newest count of each bucket, open ones included."""
    counts = _run_updates(spark, feed.bucket_counts_stream(_event_stream(spark, d)), "stream_buckets", ["key", "bucket"])
    z = feed.zscores_from_counts(counts)
    return z.select("key", ntz("bucket").alias("bucket"), "count", "n_buckets", r6("zscore").alias("zscore"))
