"""Registered queries of the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import (bpe, decontamination, fingerprints, importance, licences, line_dedup, mixing, near_dups,
                           periodic_runs, quality, token_counts, url_rules, warc)
from sieveline.llm.common import SPACE_CLASS, read, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


#: n_tokens above this is over the limit.
TOKEN_LIMIT = 512


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every text: digests of the ids and of the decoded text."""
    encoded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return bpe.decode(encoded).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are counted once and written without the texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = written(mixing.sized(docs).drop("text"), "mix-sizes")
    return mixing.mix(docs, sizes=sizes).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan_licences(docs).drop("text")


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dups.near_duplicates(docs).drop("__hash")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was deleted from each document, and digests of what is left."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    runs = F.expr("array_join(transform(removed_runs, r -> concat(r.from, '-', r.to)), ',')")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", runs.alias("removed_runs"), F.sha2("text", 256).alias("text_sha256"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say when they are read back."""
    records, _ = warc.archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.where("gap IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.edited_texts(docs).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("vector")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        fingerprints.likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))


@query
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the id of the document it shows, which labels refer to."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, read(spark, sf_dir, "labels")).select(
        "page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", "n_whole",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdicts of all documents; the narrow metrics are written once and used twice."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = written(quality.measure(docs).drop("text"), "quality-metrics")
    judged = quality.judge(measured, quality.fences(measured))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document (by CRC-32 of its id) repeats a stretch of its own words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))

    @F.pandas_udf("string")
    def repeated(texts: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or k is None else _repeat(x, int(k)) for x, k in zip(texts, g, strict=True)], dtype=object)

    chosen = F.when(h % 10 == 0, F.col("text"))
    return docs.withColumn("text", F.coalesce(repeated(chosen, F.floor(h / 10)), "text"))


def _repeat(text: str, g: int) -> str:
    words = [w for w in re.split(f"[{SPACE_CLASS}]+", text) if w]
    n = len(words)
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS l, -r.start AS s, -r.period AS p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return periodic_runs.mark_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr("-best.s").alias("start"),
        F.expr("best.l").alias("length"), F.expr("-best.p").alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to resemble the benchmark texts; the scores are written once, without texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    corpus = importance.count_buckets(docs)
    gain = importance.gains(corpus, importance.count_buckets(read(spark, sf_dir, "benchmark")))
    digest = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    weighed = importance.weigh(docs, gain).select("doc_id", "n_words", "n_features", "weight", digest.alias("digest"))
    return importance.draw(weighed, digest="digest").select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_items(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated")


def _decontamination_sql() -> str:
    words = ("list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")
    windows = "SELECT {k}, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM {t})"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w, least(len(w), {decontamination.WINDOW}) AS k
          FROM benchmark WHERE len(w) > 0),
wanted AS ({windows.format(k="item", t="items")}),
sized AS (SELECT id, w, k FROM docs, (SELECT DISTINCT k FROM items) s),
places AS ({windows.format(k="id", t="sized")}),
hits AS (SELECT p.id, p.k, p.i, m.item FROM places p JOIN wanted m ON p.k = m.k AND p.win = m.win),
covered AS (SELECT id, count(DISTINCT i + d) AS n
            FROM (SELECT id, i, unnest(range(k)) AS d FROM (SELECT DISTINCT id, i, k FROM hits)) GROUP BY id),
named AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.id = d.id LEFT JOIN named m ON m.id = d.id"""


def _quality_sql() -> str:
    signals = " UNION ALL ".join(
        f"SELECT id, lang, source, '{k}' AS signal, {v.replace(' div ', ' // ')} AS v FROM metrics WHERE n_words > 0"
        for k, v in quality.SIGNALS.items())
    slack = " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.SLACK.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT id, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM docs),
windows AS (SELECT id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
            FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY id),
lines AS (SELECT id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
metrics AS (
  SELECT d.id, doc_id, lang, source, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(replace(t, '!', '')) AS n_shouts, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         coalesce(chars, 0)::BIGINT AS word_chars
  FROM docs d JOIN words USING (id) JOIN lines USING (id) LEFT JOIN repeats r ON r.id = d.id),
signals AS ({signals}),
bins AS (SELECT lang, source, signal, ((v >> s) << s) + (1::BIGINT << s) - 1 AS high
         FROM (SELECT *, greatest(length(bin(v)) - {quality.BIN_BITS + 1}, 0) AS s FROM signals)),
counted AS (SELECT lang, source, signal, high, count(*)::HUGEINT AS n FROM bins GROUP BY ALL),
corpus AS (SELECT signal, high, sum(n) AS c, sum(sum(n)) OVER (PARTITION BY signal) AS total FROM counted GROUP BY signal, high),
langs AS (SELECT lang, signal, high, sum(n) AS l FROM counted GROUP BY ALL),
lang_docs AS (SELECT lang, signal, sum(n) AS l_docs FROM counted GROUP BY ALL),
group_docs AS (SELECT lang, source, signal, sum(n) AS g_docs FROM counted GROUP BY ALL),
weights AS (
  SELECT g.lang, g.source, g.signal, c.high, (d.l_docs + {quality.SHRINK}) * c.total AS d,
         (g.g_docs + {quality.SHRINK}) * (d.l_docs + {quality.SHRINK}) * c.total AS whole,
         coalesce(o.n, 0) * (d.l_docs + {quality.SHRINK}) * c.total
         + {quality.SHRINK} * (coalesce(l.l, 0) * c.total + {quality.SHRINK} * c.c) AS w
  FROM group_docs g JOIN corpus c ON g.signal = c.signal
  JOIN lang_docs d ON d.lang IS NOT DISTINCT FROM g.lang AND d.signal = g.signal
  LEFT JOIN langs l ON l.lang IS NOT DISTINCT FROM g.lang AND l.signal = g.signal AND l.high = c.high
  LEFT JOIN counted o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source
                         AND o.signal = g.signal AND o.high = c.high),
ranked AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, signal ORDER BY high) AS upto FROM weights),
quartiles AS (SELECT lang, source, signal, min(high) FILTER (4 * upto >= whole) AS q1,
                     min(high) FILTER (4 * upto >= 2 * whole) AS q2 FROM ranked GROUP BY ALL),
limits AS (SELECT lang, source, signal,
                  q2 + greatest({quality.LOWER_SPREAD} * (q2 - q1), CASE signal {slack} END) AS fence FROM quartiles),
odd AS (SELECT s.id, string_agg(s.signal, ',' ORDER BY list_position({list(quality.SIGNALS)}, s.signal)) AS names
        FROM signals s JOIN limits f ON s.lang IS NOT DISTINCT FROM f.lang
          AND s.source IS NOT DISTINCT FROM f.source AND s.signal = f.signal
        WHERE s.v > f.fence GROUP BY s.id),
judged AS (SELECT m.*, coalesce(names, '') AS failed_rules,
                  n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
           FROM metrics m LEFT JOIN odd USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM judged"""


def _mixing_sql() -> str:
    turns = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    share = f"{mixing.SHARE_PERCENT} * total"
    return f"""
WITH docs AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                                         lambda x: x <> '')) AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, {mixing.CAP} * source_size AS cap, sum(source_size) OVER () AS total,
                  CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {turns} END AS w
           FROM sources),
running AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM ranked),
capped AS (SELECT *, ({share} - 100 * before) * w >= 100 * cap * open_w AS is_full FROM running),
goal AS (SELECT source, source_size,
                CASE WHEN is_full THEN cap::DOUBLE
                     ELSE (w * ({share} - 100 * sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()))::DOUBLE
                          / (100 * sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM capped),
placed AS (SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS words,
                  sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS p
           FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (greatest(0, least(p + size, words) - p)
        + greatest(0, least(p + source_size + size, words) - p - source_size))::BIGINT AS taken
FROM placed"""


SQL["op2_mixing"] = _mixing_sql()
SQL["op10_quality_rules"] = _quality_sql()
SQL["op13_decontamination"] = _decontamination_sql()
