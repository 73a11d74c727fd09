"""Corpus preparation in five stages over the ``documents`` table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, common, line_dedup, mixing, near_dups, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_rules(docs).where("kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages go, inside lines too; so do documents of which no word is left. n_chars follows the text."""
    left = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(common.WORD_PATTERN))
    return _with_length(left, docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return near_dups.deduplicated(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in the order of its schedule: a document taken more than once has several rows; one cut at a target
    has its first words."""
    return _with_length(mixing.mixture(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (uint32, little-endian), with the digest of the text they decode to."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return bpe.decode(ids).select("doc_id", "lang", "source", "n_tokens", "token_ids",
                                  F.sha2("decoded_text", 256).alias("decoded_sha256"))


def _with_length(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("near-duplicate documents", dedup_documents),
          ("source mixing", mix_sources), ("bpe encoding", encode)]

#: Hash windows, signatures and token merges have no SQL twin; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
