"""S5 dispatch, deterministic ids, S6 ingest report and rejects, and the
end-to-end file ingest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sieveline.functions.text import is_blank, strip
from sieveline.schema import LOG_COLUMNS
from sieveline.operators.joins import join_small
from sieveline.sources import cef, csvlog, jsonlog, syslog
from sieveline.sources.common import POSITION_COLUMNS, default_ingested_at, finish, nonblank_lines
from sieveline.sources.files import read_directory, read_documents, read_lines
from sieveline.sources.scratch import written
from sieveline.sources.sniff import classify, document_check, file_profile, needs_document


PARSERS = [("syslog", syslog), ("cef", cef), ("csv", csvlog), ("json", jsonlog), ("windows_event", jsonlog.windows)]


def parse_auto(lines: DataFrame, formats: DataFrame, docs: DataFrame | None = None,
               year: int | None = None, column_mapping: dict | None = None,
               strict_reference_severity: bool = False, ingested_at: datetime | None = None,
               elements: DataFrame | None = None) -> DataFrame:
    """Parse every file with the parser of its detected format, in one
    projection over one scan of the lines.

    ``formats`` is the output of ``sniff_formats`` (one row per file); lines
    are tagged with it by a join on ``source_file`` -- the per-file table is
    small and AQE turns the join into a broadcast at run time. Unknown types
    use the syslog parser. One-line JSON documents are exploded in place;
    multi-line documents come whole from ``docs`` (source_file, text), or as
    the ``elements`` that ``jsonsplit`` finds in arrays.
    """
    f = formats.select("source_file", "log_type", "json_mode", "header", "n_nonblank", "first_pos",
                       *(["csv_multiline"] if "csv_multiline" in formats.columns else []))
    # One row per file, written once, broadcast after a size check (else a shuffle join).
    f = written(f, "formats")
    tagged = join_small(lines, f, "source_file", keep=False)
    if "csv_multiline" in f.columns and f.where("csv_multiline").limit(1).count():
        # CSV files with quoted newlines: rebuild their records first (only
        # these files take the extra window/group steps).
        multi = F.coalesce(F.col("csv_multiline"), F.lit(False))
        recs = csvlog.assemble_records(tagged.where(multi).select("value", "source_file", "block_start",
                                                                  "line_no_key"))
        recs = join_small(recs, f.where("csv_multiline").drop("csv_multiline"), "source_file", keep=False)
        tagged = tagged.where(~multi).drop("csv_multiline").unionByName(recs)
    elif "csv_multiline" in f.columns:
        tagged = tagged.drop("csv_multiline")
    is_doc = F.col("json_mode") == "document"
    tagged = tagged.where(~is_doc | (F.col("n_nonblank") == 1))
    rows = _explode_documents(tagged, is_doc)
    whole = f.where(is_doc & (F.col("n_nonblank") > 1)).select("source_file", "log_type", "header")
    parts = [] if elements is None else [elements]
    if docs is not None:
        parts.append(jsonlog.json_documents(docs.join(whole, "source_file", "left_semi")))
    for objs in parts:
        rows = rows.unionByName(join_small(objs, whole, "source_file", keep=False).withColumn("is_header", F.lit(False)))
    kw = dict(year=year, column_mapping=column_mapping, strict_reference_severity=strict_reference_severity,
              ingested_at=ingested_at or default_ingested_at())
    stages, rec, log_type = _dispatch_columns(rows.sparkSession, **kw)
    df = nonblank_lines(rows)
    for cols in stages:
        df = df.withColumns(cols)
    return finish(df.withColumn("_rec", rec), log_type, kw["ingested_at"])


_DISPATCH_CACHE: dict = {}
#: Parameter sets kept; a job uses one.
MAX_CACHED = 8


def _dispatch_columns(spark, **kw):
    """The dispatch expressions depend only on the parameters, not on the
    data: build them once per session and parameters (building them is
    thousands of driver calls)."""
    key = (spark.sparkContext.applicationId, kw["year"], tuple(sorted((kw["column_mapping"] or {}).items())),
           kw["strict_reference_severity"], kw["ingested_at"])
    if key not in _DISPATCH_CACHE:
        if len(_DISPATCH_CACHE) >= MAX_CACHED:
            _DISPATCH_CACHE.clear()
        kinds = [k for k, _ in PARSERS if k != "syslog"]
        on = {k: F.col("log_type") == k for k in kinds}
        on["syslog"] = ~F.col("log_type").isin(*kinds)
        per = [mod.stages(on[kind], **kw) for kind, mod in PARSERS]
        stages = []
        for i in range(max(len(p) for p in per)):
            cols: dict = {}
            for p in per:
                if i < len(p):
                    cols.update(p[i])
            stages.append(cols)
        rec = F.coalesce(*[mod.fields(on[kind], **kw) for kind, mod in PARSERS])
        log_type = F.when(on["syslog"], F.lit("syslog")).otherwise(F.col("log_type"))
        _DISPATCH_CACHE[key] = (stages, rec, log_type)
    return _DISPATCH_CACHE[key]


def _explode_documents(tagged: DataFrame, is_doc) -> DataFrame:
    """Lines of line-format files as they are; a one-line JSON document file
    becomes one row per top-level element."""
    elems = F.when(is_doc, F.coalesce(jsonlog.json_elements(strip(F.col("value"))), F.array().cast("array<string>"))) \
             .otherwise(F.array(F.col("value")))
    # A CSV header is known by its position, so that a line with the same text stays a row.
    at_first = F.struct("block_start", "line_no_key") == F.col("first_pos")
    out = tagged.select("source_file", "block_start", "log_type", "header", "line_no_key", is_doc.alias("_doc"),
                        at_first.alias("is_header"), F.posexplode(elems).alias("_pos", "_v"))
    return out.select(F.col("_v").alias("value"), "source_file", "block_start",
                      F.when(F.col("_doc"), F.col("_pos").cast("long")).otherwise(F.col("line_no_key")).alias("line_no_key"),
                      "log_type", "header", "is_header")


def assign_ids(logs: DataFrame) -> DataFrame:
    """Deterministic ids: md5(source_file, raw, k), k = rank of the line among
    identical raw lines of its file in file order.

    The rank is split in two so a file full of one repeated line never lands
    in one task: a rank inside each file split (bounded by the split size) plus
    the count of the same line in earlier splits, from a small per-split
    count table. Same files give the same ids on every run and every retry,
    so re-ingest is idempotent.
    """
    local_w = Window.partitionBy("source_file", "raw", "block_start").orderBy("line_no_key")
    ranked = logs.withColumn("_lk", F.row_number().over(local_w))
    per_split = logs.groupBy("source_file", "raw", "block_start").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source_file", "raw").orderBy("block_start") \
                   .rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select("source_file", "raw", "block_start",
                               F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    k = F.col("_off") + F.col("_lk")
    out = ranked.join(offsets, ["source_file", "raw", "block_start"])
    return out.withColumn("id", F.md5(F.concat_ws("\u001f", "source_file", "raw", k.cast("string")))) \
              .select(*LOG_COLUMNS, *POSITION_COLUMNS)


def ingest_report(lines: DataFrame, formats: DataFrame, logs: DataFrame) -> DataFrame:
    """S6 per file: total_lines (between the first and last non-blank line),
    parsed, failed = max(0, total_lines - parsed), rejected (non-blank lines
    of line formats that produced no row, headers excluded), log_type."""
    pos = F.struct("block_start", "line_no_key")
    f = formats.select("source_file", "log_type", "json_mode", "first_pos", "last_pos", "n_nonblank", "n_lines")
    # Lines outside the first..last non-blank span are blank by definition;
    # only blank lines (few) are joined back to find them.
    blank = lines.where(is_blank(F.col("value"))).select("source_file", "block_start", "line_no_key")
    outside = (join_small(blank, f.select("source_file", "first_pos", "last_pos"), "source_file")
               .where((pos < F.col("first_pos")) | (pos > F.col("last_pos")))
               .groupBy("source_file").agg(F.count(F.lit(1)).alias("outside")))
    parsed = logs.groupBy("source_file").agg(F.count(F.lit(1)).alias("parsed"))
    rep = f.join(outside, "source_file", "left").join(parsed, "source_file", "left")
    total = F.when(F.col("n_nonblank") == 0, F.lit(0)) \
             .otherwise(F.col("n_lines") - F.coalesce(F.col("outside"), F.lit(0)))
    got = F.coalesce(F.col("parsed"), F.lit(0))
    header = F.when(F.col("log_type") == "csv", 1).otherwise(0)
    rejected = F.when(F.col("json_mode") == "lines", F.greatest(F.col("n_nonblank") - header - got, F.lit(0))) \
                .otherwise(F.lit(0))
    return rep.select("source_file", "log_type", total.cast("long").alias("total_lines"), got.cast("long").alias("parsed"),
                      F.greatest(total - got, F.lit(0)).cast("long").alias("failed"), rejected.cast("long").alias("rejected"),
                      F.array().cast("array<string>").alias("errors"))


def summarize_report(report: DataFrame) -> DataFrame:
    """Counters summed over files; the directory log_type is unknown."""
    return report.agg(
        F.lit("unknown").alias("log_type"),
        F.coalesce(F.sum("total_lines"), F.lit(0)).cast("long").alias("total_lines"),
        F.coalesce(F.sum("parsed"), F.lit(0)).cast("long").alias("parsed"),
        F.coalesce(F.sum("failed"), F.lit(0)).cast("long").alias("failed"),
        F.coalesce(F.sum("rejected"), F.lit(0)).cast("long").alias("rejected"),
        F.flatten(F.collect_list("errors")).alias("errors"),
    )


def rejects(lines: DataFrame, formats: DataFrame, logs: DataFrame) -> DataFrame:
    """Non-blank lines of line-format files that gave no row (CSV headers
    aside). CSV files with quoted newlines are left out: their continuation
    lines belong to records started on earlier lines."""
    f = formats.where(F.col("json_mode") == "lines")
    if "csv_multiline" in f.columns:
        f = f.where(~F.coalesce(F.col("csv_multiline"), F.lit(False)))
    f = f.select("source_file", "log_type", "first_pos")
    nb = join_small(lines.where(~is_blank(F.col("value"))), f, "source_file")
    at_first = F.struct("block_start", "line_no_key") == F.col("first_pos")
    nb = nb.where(~((F.col("log_type") == "csv") & at_first))
    return nb.join(logs.select("source_file", *POSITION_COLUMNS), ["source_file", *POSITION_COLUMNS], "left_anti") \
             .select("source_file", "block_start", "line_no_key", "log_type", "value")


def json_parts(spark: SparkSession, profile: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(docs, elements, checks) of the files in a profile that may be JSON documents of several lines: arrays are read
    in parts by many tasks (``jsonsplit``), single objects whole. Only file names come to the driver, as for listings."""
    from sieveline.sources import jsonsplit
    pending = profile.where(needs_document(profile)).select("source_file", F.col("first").startswith("[").alias("a")).collect()
    arrays, objects = ([r.source_file for r in pending if r.a == kind] for kind in (True, False))
    docs = read_documents(spark, objects) if objects else None
    checks = document_check(docs) if docs is not None else None
    elements = None
    if arrays:
        elements, found = jsonsplit.array_elements(jsonsplit.read_pieces(spark, arrays))
        checks = found if checks is None else checks.unionByName(found)
    return docs, elements, checks


class Ingested:
    """Result of ``ingest_files``: logs, per-file report and rejects."""

    def __init__(self, logs: DataFrame, report: DataFrame, rejects: DataFrame | None, formats: DataFrame | None):
        self.logs, self.report, self.rejects, self.formats = logs, report, rejects, formats


def _error_report(spark: SparkSession, path: str, message: str) -> DataFrame:
    return spark.createDataFrame(
        [(path, "unknown", 0, 0, 0, 0, [message])],
        "source_file string, log_type string, total_lines long, parsed long, failed long, "
        "rejected long, errors array<string>")


def ingest_files(spark: SparkSession, paths: str | list[str], directory: bool = False,
                 log_type: str | None = None, year: int | None = None, column_mapping: dict | None = None,
                 strict_reference_severity: bool = False, ingested_at: datetime | None = None) -> Ingested:
    """S1/S2 + S4 + S5 + ids + S6. A missing path gives an error report and
    no rows. ``log_type`` forces one format for every file."""
    try:
        lines = read_directory(spark, paths) if directory else read_lines(spark, paths)
        lines.schema  # resolve the listing now
    except AnalysisException as exc:
        p = paths if isinstance(paths, str) else ",".join(paths)
        msg = f"File not found: {p}" if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc) else str(exc)
        empty = spark.createDataFrame([], spark.range(0).select(
            *[F.lit(None).cast(t).alias(n) for n, t in
              [("id", "string"), ("timestamp", "timestamp"), ("source", "string"), ("hostname", "string"),
               ("severity", "string"), ("message", "string"), ("raw", "string"),
               ("metadata", "map<string,string>"), ("source_file", "string"), ("log_type", "string"),
               ("ts_quality", "string"), ("ingested_at", "timestamp"), ("event_date", "date")]]).schema)
        return Ingested(empty, _error_report(spark, p, msg), None, None)
    profile = written(file_profile(lines), "file-profile")
    docs, elements, checks = json_parts(spark, profile)
    formats = classify(profile, checks)
    if log_type:
        formats = formats.withColumn("log_type", F.lit(log_type))
    logs = assign_ids(parse_auto(lines, formats, docs, year=year, column_mapping=column_mapping,
                                 strict_reference_severity=strict_reference_severity, ingested_at=ingested_at,
                                 elements=elements))
    report = ingest_report(lines, formats, logs)
    return Ingested(logs.select(*LOG_COLUMNS), report, rejects(lines, formats, logs), formats)
