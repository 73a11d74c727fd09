"""Quality rules with adaptive thresholds (native DataFrame operators only).

Every document gets text signals; every (language, source) group gets a
mergeable quantile sketch of each signal; the fences that decide are read from
the sketches instead of fixed cutoffs, and documents are joined with the
fences of their group.

A sketch is a histogram with log-spaced integer bins: counts add up, so it
merges in any order, gives the same fences on every run, and has a bounded
number of rows however many documents the group has.

A group's sketch is read together with ``SHRINK`` documents' worth of its
language's, which in turn is read with as much of the whole corpus's: a large
group decides by itself, a small one mostly by the others, and one document
more never changes much. The fence stands on the median and the lower
quartile, so what is bad above the median does not move it. (A group of more
than ``SHRINK`` documents of which over half is bad still passes.)

Defined results: null or empty text has no words and fails the base rule; a
null language or source is a group of its own; repeated rows each count; an
empty table gives no rows; input columns that clash with an output name are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.common import SPACE_CHARS, SPACE_CLASS, WORD_PATTERN, replace_columns, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts"]

#: Signals with a fence, as whole thousandths: symbols and exclamation marks per word, equal lines per line,
#: characters per word.
SIGNALS = {
    "symbols": "1000 * n_symbols div n_words",
    "shouts": "1000 * n_shouts div n_words",
    "dup_lines": "1000 * n_dup_lines div n_lines",
    "word_length": "1000 * word_chars div n_words",
}
#: A fence is never nearer to the median than this (thousandths).
SLACK = {"symbols": 250, "shouts": 500, "dup_lines": 600, "word_length": 4000}
#: Fence: median + LOWER_SPREAD * (median - lower quartile), or the slack if that is more.
LOWER_SPREAD = 13
#: Documents of the language's sketch (and of the corpus's, for a language) that are read with a group's.
SHRINK = 100
#: A sketch bin is 1/16 of its value wide at most.
BIN_BITS = 4


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``METRICS`` (long) to every document; one pass over the text, no shuffle.

    Repeated words: 3-word windows are hashed to 64 bits. A hash-set pass finds
    the texts that repeat none; for the others (hash, position) pairs are sorted,
    equal neighbours flagged, and covered words counted from the gaps between
    flagged positions.
    """
    base = replace_columns(docs, METRICS)
    staged = (
        base.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("__words", F.expr(f"array_remove(split(__text, r'[{SPACE_CLASS}]+'), '')"))
        .withColumn("__lines", F.expr(f"filter(split(__text, '\n'), x -> x rlike r'{WORD_PATTERN}')"))
        .withColumn("__n", F.size("__words").cast("long"))
        .withColumn("__grams", F.expr(
            "CASE WHEN __n < 3 THEN array() ELSE transform(sequence(0, cast(__n - 3 AS int)), "
            "i -> xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2))) END"))
        .withColumn("__pairs", F.expr(
            "CASE WHEN size(array_distinct(__grams)) < size(__grams) "
            "THEN array_sort(transform(__grams, (h, i) -> struct(h, i))) END"))
        .withColumn("__places", F.expr(
            "array_sort(transform(filter(__pairs, (p, i) -> p.h = get(__pairs, i - 1).h "
            "OR p.h = get(__pairs, i + 1).h), p -> p.i))"))
        .withColumn("__repeats", F.expr(
            "coalesce(aggregate(__places, struct(0L AS n, -3 AS last), "
            "(a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n), 0L)")))
    metrics = {
        "n_words": F.col("__n"),
        "word_chars": F.length(F.translate("__text", SPACE_CHARS, "")),
        "n_symbols": F.length("__text") - F.length(F.translate("__text", SYMBOLS, "")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.col("__repeats"),
        "n_lines": F.size("__lines"),
        "n_shouts": F.regexp_count("__text", F.lit("!")),
    }
    # The generator keeps later projections and filters from copying these expressions into themselves.
    return staged.select(*[F.col(f"`{c}`") for c in base.columns], F.inline(F.array(F.struct(
        *[metrics[m].cast("long").alias(m) for m in METRICS]))))


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Quantile sketches: (lang, source, signal, low, high, n), one row per bin that has documents."""
    signals = F.array(*[F.struct(F.lit(k).alias("signal"), F.expr(v).alias("v")) for k, v in SIGNALS.items()])
    shift = f"greatest(length(bin(v)) - {BIN_BITS + 1}, 0)"
    return (
        measured.where("n_words > 0")
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(signals))
        .withColumn("s", F.expr(shift))
        .withColumn("low", F.expr("shiftleft(shiftright(v, s), s)"))
        .withColumn("high", F.expr("low + shiftleft(1L, s) - 1"))
        .groupBy("lang", "source", "signal", "low", "high").agg(F.count("*").alias("n")))


def fences(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Upper fence of each signal per (lang, source), read from the shrunk sketches; a written table.

    Shares are compared in whole numbers: a bin's weight in a group is its count times D, plus SHRINK times its
    weight in the language, where D = (language's documents + SHRINK) * (all documents).
    """
    bins = written(sketches(measured, lang, source).withColumn("n", F.col("n").cast("decimal(38,0)")), "quality-sketches")

    def merged(*keys: str) -> DataFrame:
        """Bins of all groups with equal keys, with the number of documents."""
        total = F.sum(F.sum("n")).over(W.partitionBy(*keys, "signal"))
        return bins.groupBy(*keys, "signal", "high").agg(F.sum("n").alias("n"), total.alias("docs"))

    def whole(x) -> Column:
        return F.expr(x).cast("decimal(38,0)")
    of_all = merged().select("signal", "high", F.col("n").alias("c"), F.col("docs").alias("all"))
    of_lang, of_group = merged("lang"), merged("lang", "source")
    # Every group has a row for every bin of its signals: a bounded number for a group.
    groups = of_group.select("lang", "source", "signal", F.col("docs").alias("g_docs")).distinct()
    langs = of_lang.select(F.col("lang").alias("l_lang"), F.col("signal").alias("l_signal"), F.col("high").alias("l_high"),
                           F.col("n").alias("l"))
    lang_docs = of_lang.select(F.col("lang").alias("d_lang"), F.col("signal").alias("d_signal"), F.col("docs").alias("l_docs")).distinct()
    own = of_group.select(F.col("lang").alias("o_lang"), F.col("source").alias("o_source"), F.col("signal").alias("o_signal"),
                          F.col("high").alias("o_high"), F.col("n").alias("g"))
    table = (
        groups.join(of_all, "signal")
        .join(lang_docs, F.col("lang").eqNullSafe(F.col("d_lang")) & (F.col("signal") == F.col("d_signal")))
        .join(langs, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("signal") == F.col("l_signal"))
              & (F.col("high") == F.col("l_high")), "left")
        .join(own, F.col("lang").eqNullSafe(F.col("o_lang")) & F.col("source").eqNullSafe(F.col("o_source"))
              & (F.col("signal") == F.col("o_signal")) & (F.col("high") == F.col("o_high")), "left")
        .withColumn("d", whole(f"(l_docs + {SHRINK}) * all"))
        .withColumn("w", whole(f"coalesce(g, 0) * d + {SHRINK} * (coalesce(l, 0) * all + {SHRINK} * c)"))
        .withColumn("total", whole(f"(g_docs + {SHRINK}) * d")))
    upto = W.partitionBy("lang", "source", "signal").orderBy("high").rowsBetween(W.unboundedPreceding, 0)
    quartiles = (table.withColumn("upto", F.sum("w").over(upto).cast("decimal(38,0)"))
                 .groupBy("lang", "source", "signal").agg(
                     *[F.min(F.when(F.expr(f"4 * upto >= {k} * total"), F.col("high"))).alias(f"q{k}") for k in (1, 2)]))
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])
    fence = F.col("q2") + F.greatest(LOWER_SPREAD * (F.col("q2") - F.col("q1")), slack[F.col("signal")])
    return written(quartiles.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("signal") == k, fence)).alias(f"max_{k}") for k in SIGNALS]), "quality-fences")


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Join documents with their group's fences; adds base_failed, failed_rules (names) and kept.

    The fences' table is written, so its size is known and Spark broadcasts it
    only below its threshold; above it the join is shuffled, hot groups being
    split by adaptive execution.
    """
    docs = replace_columns(measured, ["base_failed", "failed_rules", "kept"])
    f = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"),
                      *[F.col(f"max_{k}").alias(f"__max_{k}") for k in SIGNALS])
    joined = docs.join(f, docs[lang].eqNullSafe(f["__lang"]) & docs[source].eqNullSafe(f["__source"]), "left")
    odd = [F.when(F.expr(f"n_words > 0 AND {v} > __max_{k}"), F.lit(k)) for k, v in SIGNALS.items()]
    return (
        joined
        .withColumn("base_failed", F.expr(
            f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
        .withColumn("failed_rules", F.array_compact(F.array(*odd)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .select(*[F.col(f"`{c}`") for c in docs.columns], "base_failed", "failed_rules", "kept"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All documents with their metrics, failed rules and verdict; the text is measured once and written with it."""
    measured = written(measure(docs, text), "quality-measured")
    return judge(measured, fences(measured, lang, source), lang, source)
