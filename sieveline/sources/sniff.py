"""Detect the format of every file with one aggregate per file.

Works across file splits: the first non-blank line is ``min_by`` over the
(block_start, line_no_key) position, and "any later line starts with CEF:"
is a ``bool_or``. Only files whose first line opens a JSON document need
their whole text (``docs``) to decide between a document and JSON lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import is_blank, strip
from sieveline.sources.csvlog import opens_quote
from sieveline.sources.jsonlog import WINDOWS_KEYS
from sieveline.sources.scratch import written

# --- fixed values (detection shapes of the original tool) ----------------------
CSV_HEADER_FIELD = r"(?U)^[\w_\- ]+$"
SYSLOG3164_HEAD = r"(?U)^(<\d{1,3}>)?\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
SYSLOG5424_HEAD = r"(?U)^<\d{1,3}>\d+\s+"
# --------------------------------------------------------------------------------

OBJ = "map<string,string>"


def file_profile(lines: DataFrame) -> DataFrame:
    """Per file, in one aggregate over all its lines: first/last non-blank
    line position, the first non-blank line, line counts, any CEF line.
    Files with only blank lines stay: their first line is NULL, they detect
    as syslog and give no rows, like the original tool."""
    nonblank = ~is_blank(F.col("value"))
    pos = F.when(nonblank, F.struct("block_start", "line_no_key"))
    prof = lines.groupBy("source_file").agg(
        F.min_by(F.col("value"), pos).alias("first_value"),
        F.min(pos).alias("first_pos"),
        F.max(pos).alias("last_pos"),
        F.count_if(nonblank).alias("n_nonblank"),
        F.count(F.lit(1)).alias("n_lines"),
        F.bool_or(F.col("value").startswith("CEF:")).alias("any_cef"),
        F.bool_or(opens_quote(F.col("value"))).alias("open_quotes"),
    )
    return prof.withColumn("first", strip(F.col("first_value"))).drop("first_value")


def _keys_hit(obj_text: Column) -> Column:
    keys = F.map_keys(F.from_json(obj_text, OBJ))
    return F.exists(keys, lambda k: k.isin(*WINDOWS_KEYS))


def needs_document(profile: DataFrame) -> Column:
    """Files whose JSON-ness can only be decided on the whole text."""
    first = F.col("first")
    complete_obj = first.startswith("{") & first.endswith("}") & F.from_json(first, OBJ).isNotNull()
    return ((first.startswith("{") | first.startswith("[")) & (F.col("n_nonblank") > 1) & ~complete_obj
            & ~(F.col("any_cef") | first.startswith("CEF:")))


def document_check(docs: DataFrame) -> DataFrame:
    """(source_file, doc_valid, doc_windows) for whole JSON documents."""
    t = strip(F.col("text"))
    arr = F.when(t.startswith("[") & t.endswith("]"), F.from_json(t, "array<string>"))
    obj_ok = t.startswith("{") & t.endswith("}") & F.from_json(t, OBJ).isNotNull()
    first_obj = F.when(obj_ok, t).otherwise(F.try_element_at(arr, F.lit(1)))
    first_is_obj = F.coalesce(first_obj.startswith("{") & F.from_json(first_obj, OBJ).isNotNull(), F.lit(False))
    valid = obj_ok | arr.isNotNull()
    return docs.select("source_file", valid.alias("doc_valid"),
                       (valid & first_is_obj & F.coalesce(_keys_hit(first_obj), F.lit(False))).alias("doc_windows"))


def classify(profile: DataFrame, doc_checks: DataFrame | None = None) -> DataFrame:
    """(source_file, log_type, json_mode, header, ...) for every file."""
    if doc_checks is not None:
        profile = profile.join(doc_checks, "source_file", "left")
    else:
        profile = profile.withColumn("doc_valid", F.lit(None).cast("boolean")) \
                         .withColumn("doc_windows", F.lit(None).cast("boolean"))
    first = F.col("first")
    n = F.col("n_nonblank")
    is_cef = first.startswith("CEF:") | F.col("any_cef")
    opens_json = first.startswith("{") | first.startswith("[")
    first_obj = first.startswith("{") & first.endswith("}") & F.from_json(first, OBJ).isNotNull()
    first_arr = first.startswith("[") & first.endswith("]") & F.from_json(first, "array<string>").isNotNull()
    # One non-blank line: the first line is the whole document.
    single_doc = (n == 1) & (first_obj | first_arr)
    single_windows = single_doc & F.coalesce(
        _keys_hit(F.when(first_obj, first).otherwise(F.try_element_at(F.from_json(first, "array<string>"), F.lit(1)))),
        F.lit(False))
    multi_doc = opens_json & (n > 1) & F.coalesce(F.col("doc_valid"), F.lit(False))
    fields = F.split(first, ",")
    is_csv = ((n >= 2) & first.contains(",") & ~first.startswith("<")
              & F.forall(fields, lambda f: strip(f).rlike(CSV_HEADER_FIELD)))
    is_syslog = first.rlike(SYSLOG3164_HEAD) | first.rlike(SYSLOG5424_HEAD)
    log_type = (F.when(is_cef, "cef")
                .when(single_doc, F.when(single_windows, "windows_event").otherwise("json"))
                .when(multi_doc, F.when(F.col("doc_windows"), "windows_event").otherwise("json"))
                .when(first_obj, "json")
                .when(is_csv, "csv")
                .when(is_syslog, "syslog")
                .otherwise("syslog"))
    mode = F.when(single_doc | multi_doc, "document").otherwise("lines")
    return profile.select("source_file", log_type.alias("log_type"), mode.alias("json_mode"),
                          first.alias("header"), "first_pos", "last_pos", "n_nonblank", "n_lines",
                          (F.col("open_quotes") & is_csv).alias("csv_multiline"))


def sniff_formats(lines: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """S4 for a lines DataFrame; ``docs`` holds whole texts of the files for
    which ``needs_document`` is true (other rows are ignored)."""
    profile = written(file_profile(lines), "file-profile")
    checks = document_check(docs) if docs is not None else None
    return classify(profile, checks)
