"""best-effort timestamp parsing as a native Column expression.

Returns a struct ``(ts TIMESTAMP, quality STRING)``; quality is one of
``parsed``, ``epoch`` or NULL (caller decides the fallback, e.g. the job's
``ingested_at`` with quality ``missing``). Partial strings such as ``2024``
or ``10:00`` are rejected: a full calendar date is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ISO_DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?"
# Time of day, AM/PM and zone after a date: hour, minute, second, fraction, am/pm, zone.
_TIME = (r"(?:[ T:,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?"
         r" ?([AaPp][Mm])? ?([Zz]|[Uu][Tt][Cc]|[Gg][Mm][Tt]|[+-]\d{2}:?\d{2})?$")
_NUMERIC = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})" + _TIME
# Optional weekday, then day month year or month day year; month names by their first three letters.
_WEEKDAY = r"^(?:[A-Za-z]{3,9},? )?"
_DAY_FIRST = _WEEKDAY + r"(\d{1,2})[ /-]([A-Za-z]{3,9})\.?[ /,-]+(\d{4})" + _TIME
_MONTH_FIRST = _WEEKDAY + r"([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})" + _TIME

# --- fixed values ---------------------------------------------------------------
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# ---------------------------------------------------------------------------------


def _zone(z: Column) -> Column:
    """Zone text as the cast reads it: Z, or an offset with a colon; none stays none (the session's zone)."""
    return F.when(z == "", F.lit("")).when(z.rlike("^[+-]"), F.regexp_replace(z, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")) \
            .otherwise(F.lit("Z"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _groups(s: Column, pattern: str) -> Column:
    """Groups 1 to 9 of a text that ``pattern`` matches as an array (from 0), by one match of the pattern."""
    return F.split(F.regexp_replace(s, pattern + "(?s:.*)", "|".join(f"${i}" for i in range(1, 10))), r"\|", -1)


def _assembled(groups: Column, year: int, date) -> Column:
    """Timestamp from ``_groups``: groups 1 to 3 are the date (``date`` gives month and day), 4 to 9 those of ``_TIME``."""
    def text(g: Column) -> Column:
        month, day = date(g)
        half, at = F.lower(g[7]), F.when(g[3] != "", g[3].try_cast("int"))
        # 12 AM is 0 o'clock, 12 PM is 12; without AM or PM the hour stands.
        hour = F.when(g[7] == "", F.when(g[3] == "", "0").otherwise(g[3])).when(
            at.between(1, 12), (at % 12 + F.when(half == "pm", 12).otherwise(0)).cast("string"))
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        zero = lambda c: F.when(c == "", F.lit("0")).otherwise(c)
        return F.concat(g[year - 1], F.lit("-"), two(month), F.lit("-"), two(day), F.lit("T"), two(hour), F.lit(":"),
                        two(zero(g[4])), F.lit(":"), two(zero(g[5])), F.lit("."), zero(F.substring(g[6], 1, 6)), _zone(g[8]))
    return _once(groups, text).try_cast("timestamp")


def _month_number(name: Column) -> Column:
    at = F.call_function("locate", F.lower(F.substring(name, 1, 3)), F.lit(_MONTHS))
    return F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def normalize_ts_text(text: Column) -> Column:
    """Trimmed, single-spaced timestamp text (stage 1 of the parse)."""
    return F.regexp_replace(F.trim(text.cast("string")), r"\s{2,}|[^\S ]", " ")


def parse_normalized_ts(s: Column) -> Column:
    """Stage 2: (ts, quality) from text already passed through
    ``normalize_ts_text``. Only the branch whose shape matches is evaluated,
    and its pattern is matched once for all its groups; the struct is made once for both of its fields."""
    iso = F.when(s.contains("/"), F.regexp_replace(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")).otherwise(s)
    iso = F.when(s.contains(","), F.regexp_replace(iso, r"(\d{2}:\d{2}:\d{2}),(\d+)", "$1.$2")).otherwise(iso)
    iso = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{2}$"), s).otherwise(iso)
    compact = F.regexp_replace(F.regexp_replace(s, _COMPACT, "$1-$2-$3T$4:$5:$6"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    epoch_s = F.when(s.rlike(r"^\d{10}(\.\d+)?$"), F.timestamp_seconds(s.try_cast("double")))
    epoch_ms = F.when(s.rlike(r"^\d{13}$"), F.timestamp_millis(s.try_cast("long")))

    def numbers(g: Column) -> tuple[Column, Column]:
        # Month first unless the first number cannot be a month.
        one, two = g[0].try_cast("int"), g[1].try_cast("int")
        return F.when(one > 12, two).otherwise(one), F.when(one > 12, one).otherwise(two)
    # Years, epochs and compact forms begin with three digits, the other forms with digits or a name.
    year_first = F.when(s.rlike(_ISO_DATE), iso.try_cast("timestamp")).when(s.rlike(_COMPACT), compact.try_cast("timestamp"))
    day_first = _assembled(_groups(s, _DAY_FIRST), 3, lambda g: (_month_number(g[1]), g[0]))
    month_first = F.when(s.rlike(_MONTH_FIRST), _assembled(_groups(s, _MONTH_FIRST), 3, lambda g: (_month_number(g[0]), g[1])))
    number = _assembled(_groups(s, _NUMERIC), 3, numbers)
    digits = (s >= "0") & (s < ":")
    long = digits & s.rlike(r"^\d{3}")
    epoch = F.when(long & s.rlike(r"^\d{10}(\d{3}|\.\d+)?$"), F.coalesce(epoch_s, epoch_ms))
    parsed = (F.when(long, year_first).when(digits & s.rlike(_NUMERIC), number).when(s.rlike(_DAY_FIRST), day_first)
              .when(~digits, month_first))
    return _once(F.struct(epoch.alias("epoch"), parsed.alias("parsed")), lambda x: F.struct(
        F.coalesce(x["epoch"], x["parsed"]).alias("ts"),
        F.when(x["epoch"].isNotNull(), F.lit("epoch")).when(x["parsed"].isNotNull(), F.lit("parsed")).alias("quality")))


def parse_timestamp(text: Column) -> Column:
    """F5 as one Column expression. In DataFrame pipelines prefer
    ``with_parsed_timestamp``, which normalises the text once."""
    return parse_normalized_ts(normalize_ts_text(text))


def with_parsed_timestamp(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """F5 in two projections, so the normalised text is computed once."""
    tmp = out_col + "_text"
    return df.withColumn(tmp, normalize_ts_text(F.col(text_col))) \
             .withColumn(out_col, parse_normalized_ts(F.col(tmp))).drop(tmp)


def syslog3164_timestamp(text: Column, year: Column) -> Column:
    """RFC 3164 ``Mon D HH:MM:SS`` (no year) with an explicit year."""
    s = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), s), F.lit("yyyy MMM d HH:mm:ss"))


def to_timestamp_literal(value) -> Column:
    """A filter bound (string, date or datetime) as a TIMESTAMP literal."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, str):
        return F.lit(value).cast("timestamp")
    return F.lit(value).cast("timestamp")
