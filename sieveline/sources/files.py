"""Lines from files, directories or in-memory text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values (file suffixes taken from a directory, case-insensitive) ----
LOG_SUFFIXES = [".log", ".json", ".csv", ".txt", ".cef"]
# -------------------------------------------------------------------------------


def _ci_glob(suffixes: list[str]) -> str:
    """``*.{[lL][oO][gG],...}``: a case-insensitive suffix glob for the listing."""
    parts = ["".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in s.lstrip("."))
             for s in suffixes]
    return "*.{" + ",".join(parts) + "}"


def _with_position(df: DataFrame) -> DataFrame:
    # The id is taken right at the scan, so it follows line order inside each
    # file split; (block_start, line_no_key) orders the lines of a file.
    return df.select(
        F.col("value"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no_key"),
    )


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per line with its file and position.

    Undecodable bytes become U+FFFD. A missing path raises
    ``AnalysisException``; ``ingest_files`` turns that into an error row.
    """
    return _with_position(spark.read.text(paths))


def read_directory(spark: SparkSession, directory: str, suffixes: list[str] | None = None) -> DataFrame:
    """Lines of the files directly in ``directory`` with a log suffix."""
    reader = spark.read.option("pathGlobFilter", _ci_glob(suffixes or LOG_SUFFIXES))
    return _with_position(reader.text(directory))


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files as one row each (source_file, text); only for JSON documents."""
    return (spark.read.text(paths, wholetext=True)
            .select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text")))


def lines_from_text(spark: SparkSession, text: str, source_file: str = "<text>") -> DataFrame:
    """S3: in-memory text as a lines DataFrame (the text is the caller's)."""
    df = spark.createDataFrame([(source_file, text)], "source_file string, text string")
    return (df.select("source_file", F.posexplode(F.split(F.col("text"), r"\r\n|\r|\n")).alias("line_no_key", "value"))
            .select("value", "source_file", F.lit(0).cast("long").alias("block_start"),
                    F.col("line_no_key").cast("long")))


def documents_from_text(spark: SparkSession, text: str, source_file: str = "<text>") -> DataFrame:
    return spark.createDataFrame([(source_file, text)], "source_file string, text string")
