"""Syslog lines (RFC 5424 first, then RFC 3164, else the whole line)."""

from __future__ import annotations

import sys
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.severity import syslog_facility, syslog_severity
from sieveline.functions.text import strip
from sieveline.functions.timeparse import syslog3164_timestamp
from sieveline.sources.common import ingested_lit, record, run_one, str_map

# --- fixed values (line shapes of the original tool) -------------------------
# RFC 5424: <PRI>VERSION TIMESTAMP HOSTNAME APP-NAME PROCID MSGID REST
RFC5424 = r"(?U)^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(.*)$"
# RFC 3164: optional <PRI>, "Mon D HH:MM:SS", host, app[pid]:, message
RFC3164 = (r"(?U)^(?:<(\d{1,3})>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+([\w.\-]+)\s+"
           r"(\S+?)(?:\[(\d+)\])?:\s+(.*)$")
# -----------------------------------------------------------------------------

_SEP = "\u0000"


def regex_groups(line: Column, pattern: str, n: int) -> Column:
    """All capture groups of one match as an array (one regex pass), NULL
    when the line does not match."""
    joined = F.regexp_replace(line, pattern, _SEP.join(f"${i}" for i in range(1, n + 1)))
    return F.when(line.rlike(pattern), F.split(joined, _SEP, n))


def stages(on: Column, **_) -> list[dict[str, Column]]:
    line = F.col("line")
    return [{"syslog_g5": F.when(on, regex_groups(line, RFC5424, 8))},
            {"syslog_g3": F.when(on & F.col("syslog_g5").isNull(), regex_groups(line, RFC3164, 6))}]


def fields(on: Column, year: int | None = None, ingested_at: datetime | None = None, **_) -> Column:
    line = F.col("line")
    g5 = lambda i: F.col("syslog_g5")[i - 1]
    g3 = lambda i: F.col("syslog_g3")[i - 1]
    yr = F.lit(year) if year is not None else F.year(ingested_lit(ingested_at))
    pri5 = g5(1).cast("int")
    pri3 = F.when(g3(1) != "", g3(1).cast("int"))
    ts3 = syslog3164_timestamp(g3(2), yr)
    dash = lambda c: F.when(c == "-", F.lit("")).otherwise(c)
    rfc5424 = record(
        dash(g5(5)), dash(g5(4)), strip(g5(8)),
        str_map(("facility", syslog_facility(pri5)), ("severity_num", pri5.bitwiseAND(F.lit(7))),
                ("version", g5(2))),
        ts_text=g5(3), severity=syslog_severity(pri5))
    rfc3164 = record(
        g3(4), g3(3), g3(6), str_map(("pid", F.when(g3(5) != "", g3(5)))),
        ts_fixed=F.struct(ts3.alias("ts"), F.when(ts3.isNotNull(), F.lit("assumed_year")).alias("quality")),
        severity=F.when(pri3.isNotNull(), syslog_severity(pri3)), guess_text=g3(6))
    fallback = record(F.lit("syslog"), F.lit(""), line, F.create_map(), guess_text=line)
    return (F.when(on & F.col("syslog_g5").isNotNull(), rfc5424)
            .when(on & F.col("syslog_g3").isNotNull(), rfc3164)
            .when(on, fallback))


def normalize_syslog(lines: DataFrame, year: int | None = None,
                     ingested_at: datetime | None = None) -> DataFrame:
    """Every non-blank line gives a row. RFC 3164 has no year: ``year``
    (default: the year of ``ingested_at``) is used, ``ts_quality`` says
    ``assumed_year``."""
    return run_one(lines, sys.modules[__name__], "syslog", year=year, ingested_at=ingested_at)
