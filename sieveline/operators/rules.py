"""F8 with rules as data: threat scores by any number of (keyword, boost) rows.

Rules are found through an index of their rarest q-gram. A keyword of at least
``GRAM`` characters is anchored at the q-gram of it that is rarest in a bounded
sample of the messages (``SAMPLE_ROWS``; a heuristic, which changes the cost
and never the result), a shorter one at itself. Messages meet rules by an
equi-join on their q-grams, then the whole keyword is looked for in the
lower-cased message. The plan has the same size for any number of rules; the
rules are broadcast where they are few (checked), else the join is a shuffle.

The score is that of ``functions.severity.threat_score`` for the same rules:
0.5 times the severity's weight plus the boosts of contained keywords, added in
the order of the rules, 1 at most. Null and empty keywords have no effect; a
keyword that stands in several rules counts with each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions.severity import THREAT_KEYWORDS, severity_weight
from sieveline.operators.joins import join_small
from sieveline.sources.scratch import written

GRAM = 4
SAMPLE_ROWS = 10_000


def default_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules as (position, keyword, boost)."""
    return spark.createDataFrame([(i, k, float(b)) for i, (k, b) in enumerate(THREAT_KEYWORDS)],
                                 "position int, keyword string, boost double")


def _grams(text, size):
    """Distinct substrings of ``size`` characters of a column."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))))


def anchored(rules: DataFrame, messages: DataFrame) -> DataFrame:
    """(position, keyword, boost, gram) of rules; ``messages`` has a column ``text`` (lower-cased)."""
    given = rules.where(F.length("keyword") > 0).select("position", "keyword", F.col("boost").cast("double").alias("boost"))
    sample = messages.select("text").limit(SAMPLE_ROWS)
    seen = sample.select(F.explode(_grams(F.col("text"), GRAM)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    grams = F.coalesce(_grams(F.col("keyword"), GRAM), F.array("keyword"))
    # Of equally rare q-grams the longest rest decides nothing: the smallest one is taken.
    w = Window.partitionBy("position", "keyword", "boost").orderBy(F.coalesce("n", F.lit(0)), "gram")
    return (given.distinct().withColumn("gram", F.explode(grams)).join(seen, "gram", "left")
            .withColumn("_r", F.row_number().over(w)).where("_r = 1").select("position", "keyword", "boost", "gram"))


def rule_hits(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, position, keyword, boost) for every rule whose keyword a log's message contains."""
    texts = logs.select("id", F.lower("message").alias("text"))
    index = written(anchored(rules, texts), "rules")
    sizes = [r.n for r in index.select(F.length("gram").alias("n")).distinct().collect()]  # 1 to GRAM
    if not sizes:
        return index.select(F.lit(None).cast(logs.schema["id"].dataType).alias("id"), "position", "keyword", "boost")
    grams = F.flatten(F.array_compact(F.array(*[_grams(F.col("text"), n) for n in sizes])))
    meets = join_small(texts.withColumn("gram", F.explode(grams)), index, "gram", keep=False)
    return meets.where(F.contains("text", "keyword")).select("id", "position", "keyword", "boost")


def score_by_rules(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """The logs with ``score``; ``rules`` has (position, keyword in lower case, boost)."""
    hits = (rule_hits(logs, rules).groupBy(F.col("id").alias("_id"))
            .agg(F.array_sort(F.collect_list(F.struct("position", "keyword", "boost"))).alias("_hits")))
    start = severity_weight(F.col("severity")) * F.lit(0.5)
    total = F.aggregate(F.coalesce("_hits", F.array().cast("array<struct<position:int,keyword:string,boost:double>>")),
                        start, lambda acc, h: acc + h["boost"])
    return (logs.join(hits, F.col("id") == F.col("_id"), "left").withColumn("score", F.least(total, F.lit(1.0)))
            .drop("_id", "_hits"))
