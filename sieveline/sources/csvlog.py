"""CSV lines of any number of files with different headers, in one plan.

Each line carries its file's header (the first non-blank line, from the
per-file sniff aggregate); both are split into cells by one regular
expression (quotes and ``""`` escapes honoured) and zipped into a map keyed
by header name. Files whose quoted cells hold newlines are first rebuilt into
records by ``assemble_records``.
"""

from __future__ import annotations

import sys
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.severity import level_lookup
from sieveline.functions.text import lowered_keys
from sieveline.sources.common import record, run_one

# --- fixed values (header candidates of the original tool, in order) ----------
CSV_CANDIDATES = {
    "timestamp": ["timestamp", "time", "datetime", "date", "ts"],
    "source": ["source", "src", "src_ip", "host", "hostname", "origin"],
    "severity": ["severity", "level", "priority"],
    "message": ["message", "msg", "log", "description", "action"],
}
# -------------------------------------------------------------------------------

# A quoted cell with "" escapes. Only quotes that open a cell, and those that
# close it, have a meaning; others (5" disk) are text.
_QUOTED = r'"[^"]*(?:""[^"]*)*"'
# A cell after its comma: quoted (what follows the closing quote belongs to it) or up to the next comma.
_CELL = rf',({_QUOTED}[^,]*|[^,]*)'
_WHOLE_CELL = rf',(?:{_QUOTED}[^,]*|[^",][^,]*|(?=,|$))'
_CLOSING = r'^[^"]*(?:""[^"]*)*"(?!")'


def split_cells(line: Column) -> Column:
    """CSV cells of one line, unquoted."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), 1)
    inside = lambda x: F.replace(F.regexp_extract(x, '^"([^"]*(?:""[^"]*)*)"', 1), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.when(x.rlike("^" + _QUOTED), F.concat(
        inside(x), F.regexp_replace(x, "^" + _QUOTED, ""))).otherwise(x))


def stages(on: Column, column_mapping: dict | None = None, **_) -> list[dict[str, Column]]:
    """Needs ``header`` and ``is_header`` columns. The file's first non-blank
    line gives no record; a later line that repeats it does."""
    mapping = dict(column_mapping or {})
    line, header = F.col("line"), F.col("header")
    cells = F.when(on & ~F.coalesce(F.col("is_header"), F.lit(False)), split_cells(line))

    def col_for(field: str) -> Column:
        if field in mapping:
            return F.lit(mapping[field])
        # First header equal to a candidate ignoring case, candidates in order.
        return F.coalesce(*[F.try_element_at(F.col("csv_lh"), F.lit(c)) for c in CSV_CANDIDATES[field]])

    return [
        {"csv_c": cells},
        {"csv_h": F.when(F.col("csv_c").isNotNull(), F.transform(split_cells(header), F.trim))},
        # A row with fewer cells than the header is filled up with empty ones.
        {"csv_row": F.map_from_arrays(F.col("csv_h"), F.transform(
            F.col("csv_h"), lambda _, i: F.coalesce(F.get(F.col("csv_c"), i), F.lit("")))),
         "csv_lh": F.when(F.col("csv_h").isNotNull(), lowered_keys(F.col("csv_h"), first_wins=True))},
        {"csv_k": F.when(F.col("csv_h").isNotNull(), F.struct(*[col_for(f).alias(f) for f in CSV_CANDIDATES]))},
    ]


def fields(on: Column, strict_reference_severity: bool = False, **_) -> Column:
    row = F.col("csv_row")
    key = lambda f: F.col("csv_k")[f]
    get = lambda f: F.coalesce(F.try_element_at(row, key(f)), F.lit(""))
    has = lambda f: key(f).isNotNull()
    as_text = F.array_join(F.transform(F.map_entries(row), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    message = F.when(has("message"), get("message")).otherwise(as_text)
    sev_raw = F.when(has("severity"), F.lower(get("severity"))).otherwise(F.lit(""))
    mapped = F.array_compact(F.array(*[key(f) for f in CSV_CANDIDATES]))
    meta = F.map_filter(row, lambda k, v: ~F.array_contains(mapped, k))
    nh = F.size(F.col("csv_h"))
    n = F.size(F.col("csv_c"))
    extra = F.to_json(F.slice(F.col("csv_c"), nh + 1, F.greatest(n - nh, F.lit(1))))
    meta = F.when(n > nh, F.map_concat(meta, F.create_map(F.lit("_extra"), extra))).otherwise(meta)
    rec = record(
        F.when(has("source"), get("source")).otherwise(F.lit("")), F.lit(""), message, meta,
        ts_text=F.when(has("timestamp"), get("timestamp")),
        severity=F.when(sev_raw != "", level_lookup(sev_raw, strict_reference_severity)),
        guess_text=F.when(sev_raw != "", sev_raw).otherwise(message))
    return F.when(on & F.col("csv_h").isNotNull(), rec)


def normalize_csv(lines: DataFrame, headers: DataFrame, column_mapping: dict | None = None,
                  strict_reference_severity: bool = False, ingested_at: datetime | None = None) -> DataFrame:
    """Parse CSV lines; ``headers`` has (source_file, header) per file. The
    header is the first non-blank line of its file."""
    from sieveline.functions.text import is_blank
    from sieveline.operators.joins import join_small
    first = (lines.where(~is_blank(F.col("value"))).groupBy("source_file")
             .agg(F.min(F.struct("block_start", "line_no_key")).alias("first_pos")))
    tagged = join_small(lines, headers.select("source_file", "header").join(first, "source_file"), "source_file")
    tagged = tagged.withColumn("is_header", F.struct("block_start", "line_no_key") == F.col("first_pos")).drop("first_pos")
    return run_one(tagged, sys.modules[__name__], "csv", column_mapping=column_mapping,
                   strict_reference_severity=strict_reference_severity, ingested_at=ingested_at)


def opens_quote(line: Column) -> Column:
    """A quoted cell that starts on this line continues on the next one (the line itself starts outside of quotes)."""
    rest = F.regexp_replace(F.concat(F.lit(","), line), _WHOLE_CELL, "")
    return F.when(line.contains('"'), rest != "").otherwise(F.lit(False))


def _stays_quoted(line: Column) -> Column:
    """The line starts inside a quoted cell and ends inside one."""
    after = F.regexp_replace(line, _CLOSING + "[^,]*", "")
    return F.when(line.rlike(_CLOSING), F.regexp_replace(after, _WHOLE_CELL, "") != "").otherwise(F.lit(True))


def _state_before(df: DataFrame, part: list[str], order: str, start: Column) -> DataFrame:
    """Add ``_in``: inside quotes (1) or not (0) before each element.

    An element maps the state before it to the state after it: ``_o0`` from
    outside, ``_o1`` from inside. The last element before that forgets the
    state (both equal) and the number of flips since then give the state.
    """
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_flips", F.sum(F.when(F.col("_o0") > F.col("_o1"), 1).otherwise(0)).over(upto))
    fixed = F.when(F.col("_o0") == F.col("_o1"), F.struct(F.col("_o0").alias("v"), F.col("_flips").alias("f")))
    df = (df.withColumn("_fix", F.last(fixed, ignorenulls=True).over(before))
          .withColumn("_fb", F.coalesce(F.last("_flips").over(before), F.lit(0))))
    return df.withColumn("_in", F.when(F.col("_fix").isNull(), (start + F.col("_fb")) % 2)
                         .otherwise((F.col("_fix.v") + F.col("_fb") - F.col("_fix.f")) % 2)).drop("_fix", "_fb")


def assemble_records(lines: DataFrame) -> DataFrame:
    """CSV records whose quoted cells hold newlines, rebuilt from lines.

    A line starts a record when it does not start inside a quoted cell. That
    state is found per file split (a window per split, bounded by the split
    size) from the state before the split, which comes from a small per-split
    table. A continuation line belongs to the last record start before it;
    for lines at the head of a split that start lies in an earlier split,
    found through a small per-split table of last starts. Lines are then
    grouped per record (one group = one record) and joined with newlines.
    Output has the lines schema (position = the record's first line)."""
    split = ["source_file", "block_start"]
    pos_w = Window.partitionBy(*split).orderBy("line_no_key")
    df = (lines.withColumn("_o0", opens_quote(F.col("value")).cast("int"))
          .withColumn("_o1", _stays_quoted(F.col("value")).cast("int")))
    # Each split as one element: what it makes of either state.
    counted = _state_before(df.select(*split, "line_no_key", "_o0", "_o1"), split, "line_no_key", F.lit(0))
    last_fix = F.max(F.when(F.col("_o0") == F.col("_o1"), F.struct("line_no_key", F.col("_o0").alias("v"),
                                                                   F.col("_flips").alias("f"))))
    per_split = counted.groupBy(*split).agg(last_fix.alias("_l"), F.max("_flips").alias("_n"))
    end = lambda s: F.when(F.col("_l").isNull(), (F.lit(s) + F.col("_n")) % 2).otherwise(
        (F.col("_l.v") + F.col("_n") - F.col("_l.f")) % 2)
    per_split = per_split.select(*split, end(0).alias("_o0"), end(1).alias("_o1"))
    begins = _state_before(per_split, ["source_file"], "block_start", F.lit(0)).select(*split, F.col("_in").alias("_from"))
    df = _state_before(df.join(begins, split), split, "line_no_key", F.col("_from")).withColumn("_start", F.col("_in") == 0)
    start_pos = F.when(F.col("_start"), F.struct("block_start", "line_no_key"))
    df = df.withColumn("_own", F.last(start_pos, ignorenulls=True).over(pos_w.rowsBetween(Window.unboundedPreceding, 0)))
    last_start = df.groupBy(*split).agg(F.max(start_pos).alias("_last"))
    carry = last_start.select(*split,
                              F.last("_last", ignorenulls=True).over(
                                  Window.partitionBy("source_file").orderBy("block_start")
                                  .rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    df = df.join(carry, split)
    df = df.withColumn("_rec", F.coalesce(F.col("_own"), F.col("_carry")))
    recs = df.groupBy("source_file", "_rec").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_start", "line_no_key", "value"))),
                                 lambda s: s["value"]), "\n").alias("value"))
    return recs.select("value", "source_file", F.col("_rec.block_start").alias("block_start"),
                       F.col("_rec.line_no_key").alias("line_no_key"))
