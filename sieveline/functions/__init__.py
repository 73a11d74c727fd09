"""Scalar Column functions (no Python UDFs)."""

from sieveline.functions.severity import (cef_severity, guess_severity, is_high, level_or_guess,
                                          severity_rank, syslog_severity, threat_score, windows_level)
from sieveline.functions.text import (contains_ci, embed_text, first_ipv4, first_key, hour_floor,
                                      minute_bucket, preview, render_line, strip)
from sieveline.functions.timeparse import parse_timestamp
from sieveline.functions.vectors import cosine_distance, euclidean

__all__ = [
    "cef_severity", "guess_severity", "is_high", "level_or_guess", "severity_rank", "syslog_severity",
    "threat_score", "windows_level", "contains_ci", "embed_text", "first_ipv4", "first_key",
    "hour_floor", "minute_bucket", "preview", "render_line", "strip", "parse_timestamp",
    "cosine_distance", "euclidean",
]
