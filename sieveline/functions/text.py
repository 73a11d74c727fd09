"""Text and time scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the original tool's rules) --------------------
# Words dropped from a question before building the message pattern.
STOP_WORDS = ["show", "me", "the", "all", "from", "last", "hour", "today", "what",
              "happened", "on", "find", "get", "list"]
# Severity words looked for in a question, first hit wins.
QUESTION_SEVERITIES = ["critical", "high", "medium", "low", "info"]
# IPv4-shaped token (no octet range check).
IPV4_PATTERN = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
# Filter keys a model reply may set.
ALLOWED_FILTER_KEYS = ["query", "severity", "source", "hostname", "start_time", "end_time",
                       "limit", "offset", "log_type"]
# A word: letters, digits or underscore in any script (Python's \w).
WORD_PATTERN = r"[\p{L}\p{N}_]+"
# Preview lengths: live feed, timeline event, chat row.
FEED_PREVIEW, TIMELINE_PREVIEW, CHAT_PREVIEW = 120, 100, 80
# ---------------------------------------------------------------------------


# Characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
                 + "\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (the exact
    ``str.isspace`` set, by ``btrim`` -- no regex)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def lowered_keys(keys: Column, first_wins: bool = False) -> Column:
    """Map lower(key) -> key. With the session's LAST_WIN policy the last of
    keys equal ignoring case wins (Python dict semantics); ``first_wins``
    keeps the first instead."""
    if first_wins:
        keys = F.reverse(keys)
    return F.map_from_arrays(F.transform(keys, F.lower), keys)


def first_key(m: Column, candidates: list[str], lowered: Column | None = None) -> Column:
    """first candidate present in map ``m``; per candidate an exact key
    wins, else the last key equal to it ignoring case. NULL when none.
    ``lowered`` is ``lowered_keys(map_keys(m))`` if already computed."""
    lk = lowered if lowered is not None else lowered_keys(F.map_keys(m))
    return F.coalesce(*[F.when(F.map_contains_key(m, F.lit(c)), F.lit(c))
                        .otherwise(F.try_element_at(lk, F.lit(c.lower()))) for c in candidates])


def kv_map(text: Column, pattern: str) -> Column:
    """``key=value`` pairs found by ``pattern`` (group 1 key, group 2
    value) as a map; values stripped; last duplicate wins."""
    keys = F.regexp_extract_all(text, F.lit(pattern), 1)
    vals = F.transform(F.regexp_extract_all(text, F.lit(pattern), 2), lambda v: strip(v))
    return F.map_from_arrays(keys, vals)


def hour_floor(ts: Column) -> Column:
    """F10."""
    return F.date_trunc("hour", ts)


def minute_bucket(ts: Column, minutes: int = 10) -> Column:
    """floor to ``minutes`` since the epoch."""
    width = minutes * 60 * 1_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(width)).cast("long") * F.lit(width))


def clamp1(x: Column) -> Column:
    """F12."""
    return F.least(x, F.lit(1.0))


def first_ipv4(text: Column) -> Column:
    """first IPv4-shaped token, NULL when none."""
    v = F.regexp_extract(text, IPV4_PATTERN, 0)
    return F.when(v != "", v)


def question_keywords(text: Column) -> Column:
    """word tokens, lower-cased, longer than 2, minus stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def keyword_like_pattern(keywords: Column) -> Column:
    """``%a%b%`` (order kept), NULL for no keywords."""
    return F.when(F.size(keywords) > 0, F.concat(F.lit("%"), F.array_join(keywords, "%"), F.lit("%")))


def question_start_time(text: Column, as_of: Column) -> Column:
    """relative start from ``last hour``, ``last 24 hours``/``last day``, ``today``."""
    t = F.lower(text)
    return (F.when(t.contains("last hour"), as_of - F.expr("INTERVAL 1 HOUR"))
            .when(t.contains("last 24 hours") | t.contains("last day"), as_of - F.expr("INTERVAL 24 HOURS"))
            .when(t.contains("today"), F.date_trunc("day", as_of)))


def question_severity(text: Column) -> Column:
    """F16: first severity word contained (substring) in the question."""
    t = F.lower(text)
    expr = F.lit(None).cast("string")
    for sev in reversed(QUESTION_SEVERITIES):
        expr = F.when(t.contains(sev), F.lit(sev)).otherwise(expr)
    return expr


def fixed_text(x: Column, digits: int) -> Column:
    """Python's ``{:.<digits>f}`` (1 to 3 digits): the double's exact value, rounded half to even.

    ``format_string`` rounds the shortest decimal form half up, which differs (1.65 is below its decimal form). The
    fraction is taken in units of 2^-52; what is left below a unit only decides between halves.
    """
    unit = 1 << 52
    size = F.abs(x)
    whole = F.floor(size).cast("long")
    m = (size - whole) * F.lit(float(unit))
    below = (m - F.floor(m)) * F.lit(float(10 ** digits))
    scaled = F.floor(m).cast("long") * F.lit(10 ** digits) + F.floor(below).cast("long")
    q = F.shiftright(scaled, 52)
    rest = scaled - F.shiftleft(q, 52)
    up = (rest > unit // 2) | ((rest == unit // 2) & ((below != F.floor(below)) | (q % 2 == 1)))
    q = q + up.cast("long")
    whole = whole + (q >= 10 ** digits).cast("long")
    text = F.concat(whole.cast("string"), F.lit("."), F.lpad((q % 10 ** digits).cast("string"), digits, "0"))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), text)


def percent1(x: Column) -> Column:
    """Python ``{:.1%}``."""
    return F.concat(fixed_text(x * F.lit(100.0), 1), F.lit("%"))


def strip_code_fence(text: Column) -> Column:
    """drop a leading ```` ``` ```` line and the last line of a fenced reply."""
    t = strip(text)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?[^\n]*$", "")
    return F.when(t.startswith("```"), inner).otherwise(t)


def parse_filter_reply(text: Column) -> Column:
    """model reply to a filter map restricted to the allowed keys."""
    m = F.from_json(strip_code_fence(text), "map<string,string>")
    allowed = F.array(*[F.lit(k) for k in ALLOWED_FILTER_KEYS])
    return F.map_filter(m, lambda k, v: F.array_contains(allowed, k))


def embed_text(severity: Column, source: Column, hostname: Column, message: Column) -> Column:
    """``[SEV] source=.. host=.. message``, empty parts omitted."""
    def part(prefix, c):
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(prefix), c))
    return F.concat_ws(
        " ",
        F.concat(F.lit("["), F.upper(severity), F.lit("]")),
        part("source=", source),
        part("host=", hostname),
        F.when(F.coalesce(message, F.lit("")) != "", message),
    )


def preview(c: Column, n: int) -> Column:
    """First ``n`` characters plus ``...`` when longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def iso_timestamp(ts: Column) -> Column:
    """Python ``datetime.isoformat()`` of a UTC-naive timestamp."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % F.lit(1_000_000)
    return F.when(micros == 0, base).otherwise(F.concat(base, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))


def render_line(ts: Column, severity: Column, hostname: Column, source: Column, message: Column) -> Column:
    """``[ts] [SEV] host=<hostname or source> | message``."""
    host = F.coalesce(F.nullif(hostname, F.lit("")), source)
    return F.concat(F.lit("["), iso_timestamp(ts), F.lit("] ["), F.upper(severity), F.lit("] host="),
                    F.coalesce(host, F.lit("")), F.lit(" | "), F.coalesce(message, F.lit("")))


def ilike_pattern(p: str) -> str:
    """User text as a Spark ``ilike`` pattern: ``%``/``_`` stay wildcards,
    a backslash is literal."""
    return p.replace("\\", "\\\\")


def contains_ci(c: Column, p: str) -> Column:
    """Case-insensitive ``%p%`` with live wildcards."""
    return c.ilike("%" + ilike_pattern(p) + "%")
