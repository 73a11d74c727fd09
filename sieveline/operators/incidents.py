"""Deterministic incident summaries and reports (D5, D6, A12, A13, L6, L7,
U3, N11). ``by`` splits the logs into incidents (e.g. per hostname);
without it the whole input is one incident, as in the original tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.severity import rank_to_severity, severity_rank
from sieveline.functions.text import TIMELINE_PREVIEW, iso_timestamp, render_line

# --- fixed values (texts of the original tool's offline summary) ---------------
RECOMMENDATION = "Review the flagged log entries and investigate affected hosts."
REPORT_HEADER = "# Security Report (auto-generated)"
REPORT_NOTE = "*Note: LLM summarization unavailable — this is a basic auto-generated report.*"
EMPTY_TITLE, EMPTY_RECOMMENDATION = "No logs provided", "N/A"
EMPTY_REPORT = "No log data available for the specified time range."
# Defaults of fields that a model's reply leaves out.
REPLY_DEFAULTS = {"title": "Incident detected", "severity": "medium", "recommendation": "Investigate further."}
# What a model is asked, around the values.
INCIDENT_PROMPT = ("Analyze these ", " security log entries:\n\n", "\n\nProvide a JSON incident summary.")
REPORT_PROMPT = ("Security log report", " for ", ".\n\nStatistics:\n  Total logs: ", "\n  Affected hosts: ",
                 "\n\nSample logs:\n", "\n\nGenerate a professional security report.")
# Log lines shown to a model.
INCIDENT_LINES, REPORT_LINES = 50, 100
# ---------------------------------------------------------------------------------

MAX_HOSTS = 20
TIMELINE_EVENTS = 10


def _keyed(logs: DataFrame, by: list[str] | None) -> tuple[DataFrame, list[str]]:
    if by:
        return logs, list(by)
    return logs.withColumn("incident", F.lit("all")), ["incident"]


def incident_hosts(logs: DataFrame, by: list[str] | None = None, top: int | None = MAX_HOSTS) -> DataFrame:
    """U3 + L7: per incident the number of distinct non-empty hosts
    (hostnames and sources) and the first ``top`` of them sorted (None: all). Hosts are
    made distinct by an aggregate and cut by a per-group top-k, so a group
    with many hosts is never collected whole."""
    df, keys = _keyed(logs, by)
    hosts = df.select(*keys, F.explode(F.array("hostname", "source")).alias("host")) \
              .where(F.col("host").isNotNull() & (F.col("host") != "")).distinct()
    counts = hosts.groupBy(*keys).agg(F.count(F.lit(1)).alias("host_count"))
    w = Window.partitionBy(*keys).orderBy("host")
    if top is not None:
        hosts = hosts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    first = hosts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("host")), ", ").alias("affected_hosts"))
    return counts.join(first, keys)


def incident_timeline(logs: DataFrame, by: list[str] | None = None, n: int | None = TIMELINE_EVENTS) -> DataFrame:
    """The earliest ``n`` events (None: all) per incident as (rank, time, event)."""
    df, keys = _keyed(logs, by)
    w = Window.partitionBy(*keys).orderBy("timestamp", "id")
    top = df.withColumn("rank", F.row_number().over(w))
    top = top if n is None else top.where(F.col("rank") <= n)
    return top.select(*keys, "rank", iso_timestamp(F.col("timestamp")).alias("time"),
                      F.concat(F.lit("["), F.upper("severity"), F.lit("] "),
                               F.substring("message", 1, TIMELINE_PREVIEW)).alias("event"))


def _when_empty(logs: DataFrame, out: DataFrame, by: list[str] | None, **values) -> DataFrame:
    """``out``, or one row of ``values`` (other columns: null) where the whole input is one incident and has no logs."""
    if by:
        return out
    none = logs.agg(F.count(F.lit(1))).scalar() == 0
    row = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in out.schema.fields]
    return out.unionByName(logs.sparkSession.range(1).where(none).select(*row))


def incident_summary(logs: DataFrame, by: list[str] | None = None, max_hosts: int | None = MAX_HOSTS,
                     max_events: int | None = TIMELINE_EVENTS) -> DataFrame:
    """Per incident title, max severity, affected hosts (first 20),
    host count, log count, recommendation; timeline events joined as text."""
    df, keys = _keyed(logs, by)
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("log_count"),
                                 F.max(severity_rank(F.col("severity"))).alias("_rank"))
    hosts = incident_hosts(logs, by, max_hosts)
    tl = incident_timeline(logs, by, max_events).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "time", "event"))),
                                 lambda s: F.concat(s["time"], F.lit(" "), s["event"])), "\n").alias("timeline"))
    out = base.join(hosts, keys, "left").join(tl, keys, "left")
    hc = F.coalesce(F.col("host_count"), F.lit(0))
    out = out.select(
        *keys,
        F.format_string("Security incident involving %d host(s) — %d events", hc, F.col("log_count")).alias("title"),
        rank_to_severity(F.col("_rank")).alias("severity"),
        F.coalesce(F.col("affected_hosts"), F.lit("")).alias("affected_hosts"),
        hc.cast("long").alias("host_count"),
        F.col("log_count"),
        F.col("timeline"),
        F.lit(RECOMMENDATION).alias("recommendation"),
    )
    return _when_empty(logs, out, by, incident="all", title=EMPTY_TITLE, severity="info", affected_hosts="", host_count=0,
                       log_count=0, timeline="", recommendation=EMPTY_RECOMMENDATION)


def severity_breakdown(logs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``  - severity: count`` lines sorted by severity name."""
    df, keys = _keyed(logs, by)
    c = df.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("severity", "n"))),
                                 lambda s: F.format_string("  - %s: %d", s["severity"], s["n"])), "\n").alias("stats"))


def security_report(logs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The offline report text per incident."""
    df, keys = _keyed(logs, by)
    sb = severity_breakdown(logs, by)
    hosts = incident_hosts(logs, by)
    out = sb.join(hosts, keys, "left")
    text = F.concat(F.lit(REPORT_HEADER + "\n\n**Total logs:** "), F.col("total").cast("string"),
                    F.lit("\n\n**Severity breakdown:**\n"), F.col("stats"),
                    F.lit("\n\n**Affected hosts:** "), F.coalesce(F.col("affected_hosts"), F.lit("")),
                    F.lit("\n\n" + REPORT_NOTE))
    out = out.select(*keys, F.col("total").alias("log_count"), F.col("stats").alias("severity_breakdown"),
                     F.coalesce(F.col("affected_hosts"), F.lit("")).alias("affected_hosts"), text.alias("report"))
    return _when_empty(logs, out, by, incident="all", log_count=0, severity_breakdown="", affected_hosts="",
                       report=EMPTY_REPORT)


def _first_lines(logs: DataFrame, by: list[str] | None, n: int) -> DataFrame:
    """(keys, lines): the newest ``n`` logs of an incident as lines, newest first."""
    df, keys = _keyed(logs, by)
    w = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc(), "id")
    line = render_line(F.col("timestamp"), F.col("severity"), F.col("hostname"), F.col("source"), F.col("message"))
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(*keys, "_r", line.alias("line"))
    return top.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def incident_prompts(logs: DataFrame, by: list[str] | None = None, n: int = INCIDENT_LINES) -> DataFrame:
    """The text an incident is described to a model with: the number of logs and the newest ``n`` lines."""
    df, keys = _keyed(logs, by)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("log_count"))
    out = sizes.join(_first_lines(logs, by, n), keys)
    head, after, end = map(F.lit, INCIDENT_PROMPT)
    return out.select(*keys, "log_count", F.concat(
        head, F.col("log_count").cast("string"), after, F.col("lines"), end).alias("prompt"))


def report_prompts(logs: DataFrame, by: list[str] | None = None, time_range: str | None = None,
                   n: int = REPORT_LINES) -> DataFrame:
    """The text a report is asked for with: ``time_range``, statistics, hosts and the newest ``n`` lines."""
    _, keys = _keyed(logs, by)
    out = security_report(logs, by).where("log_count > 0").join(_first_lines(logs, by, n), keys)
    title, of, total, at, sample, end = REPORT_PROMPT
    head = title + (of + time_range if time_range else "") + total
    return out.select(*keys, "log_count", F.concat(
        F.lit(head), F.col("log_count").cast("string"), F.lit("\n"), F.col("severity_breakdown"), F.lit(at),
        F.col("affected_hosts"), F.lit(sample), F.col("lines"), F.lit(end)).alias("prompt"))


def summaries_from_replies(logs: DataFrame, replies: DataFrame, by: list[str] | None = None,
                           reply_col: str = "reply") -> DataFrame:
    """Incident summaries as a model's replies give them (JSON, maybe fenced; what a reply leaves out has a
    default). Incidents without a reply, or with one that is no JSON object or has no valid severity, keep their
    deterministic summary; ``from_reply`` says which."""
    from sieveline.functions.text import strip_code_fence
    from sieveline.schema import SEVERITIES

    base = incident_summary(logs, by)
    _, keys = _keyed(logs, by)
    text = strip_code_fence(F.col(reply_col))
    parsed = F.when(text.startswith("{") & text.endswith("}"), F.from_json(
        text, "title string, severity string, affected_hosts array<string>, "
              "timeline array<struct<time:string,event:string>>, recommendation string"))
    mine = replies.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], parsed.alias("p"),
                          F.from_json(text, "map<string,string>").isNotNull().alias("is_object"))
    severity = F.lower(F.coalesce("p.severity", F.lit(REPLY_DEFAULTS["severity"])))
    good = F.coalesce(F.col("is_object") & F.col("p").isNotNull() & severity.isin(*SEVERITIES), F.lit(False))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & base[k].eqNullSafe(F.col(f"_k{i}"))
    steps = F.array_join(F.transform("p.timeline", lambda t: F.concat_ws(" ", t["time"], t["event"])), "\n")

    def pick(name, value):
        return F.when(good, value).otherwise(F.col(name)).alias(name)
    return base.join(mine, match, "left").select(
        *keys, pick("title", F.coalesce("p.title", F.lit(REPLY_DEFAULTS["title"]))), pick("severity", severity),
        pick("affected_hosts", F.coalesce(F.array_join("p.affected_hosts", ", "), F.lit(""))),
        "host_count", "log_count", pick("timeline", F.coalesce(steps, F.lit(""))),
        pick("recommendation", F.coalesce("p.recommendation", F.lit(REPLY_DEFAULTS["recommendation"]))),
        good.alias("from_reply"))


#: Log lines of one call of a summarizer, and partial summaries of one call of a merger.
CHUNK_ROWS, FAN_IN = 200, 20


def summarize_incidents(logs: DataFrame, summarizer, merger, by: list[str] | None = None, chunk_rows: int = CHUNK_ROWS,
                        fan_in: int = FAN_IN) -> DataFrame:
    """D5/D6 by a user's functions, for incidents of any size: (keys, summary).

    An incident's logs in order of (timestamp, id) are cut into chunks of
    ``chunk_rows``; ``summarizer(lines) -> str`` gives a partial summary of
    each, and ``merger(summaries) -> str`` joins ``fan_in`` neighbouring ones
    at a time until one is left. So no call and no task sees more than
    ``chunk_rows`` lines or ``fan_in`` summaries of an incident, however large
    it is. The logs' places come from counts (``anomalies.with_rank``), not
    from a sort of the incident. A summary of one chunk is not merged. Both
    functions run in the tasks and should give the same text for the same
    input, since a lost executor's calls are made again.
    """
    import pandas as pd

    from sieveline.operators.anomalies import with_rank
    from sieveline.sources.scratch import written

    df, keys = _keyed(logs, by)
    line = render_line(F.col("timestamp"), F.col("severity"), F.col("hostname"), F.col("source"), F.col("message"))
    # Null keys are incidents of their own: the ranks are joined on a text of the keys that keeps them apart.
    whole = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    ranked = with_rank(df.select(whole.alias("_key"), "id", "timestamp", line.alias("line")), ["_key"])
    ranked = written(ranked.select("_key", F.floor(F.col("rank0") / chunk_rows).cast("long").alias("part"), "rank0", "line"),
                     "incident-lines")
    shape = "_key string, part long, summary string"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = pdf.sort_values("rank0")["line"].tolist()
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1], "part": pdf["part"].iloc[:1], "summary": [summarizer(lines)]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pdf.sort_values("part")["summary"].tolist()
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1], "part": pdf["part"].iloc[:1] // fan_in,
                             "summary": [merger(found) if len(found) > 1 else found[0]]})

    parts = (ranked.agg(F.max("part")).first()[0] or 0) + 1
    level = ranked.groupBy("_key", "part").applyInPandas(first, shape)
    while parts > 1:
        level = written(level, "incident-summaries")
        level = level.groupBy("_key", F.floor(F.col("part") / fan_in)).applyInPandas(merged, shape)
        parts = -(-parts // fan_in)
    names = df.select(*keys, whole.alias("_key")).dropDuplicates(["_key"])
    return names.join(level, "_key").select(*keys, "summary")


def render_lines(logs: DataFrame) -> DataFrame:
    """One prompt/report line per log."""
    return logs.select("id", "timestamp", render_line(F.col("timestamp"), F.col("severity"), F.col("hostname"),
                                                      F.col("source"), F.col("message")).alias("line"))
