"""Anomaly detectors (D1-D4) with their aggregates and windows
(A8-A11, W1-W4, J2-J4, U1, L3).

Every detector returns rows (log_id, score, is_anomaly, explanation, method,
method_order). Detectors work on whatever logs they are given; the trailing
window (P12) is applied by ``detect_anomalies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import fixed_text, minute_bucket, percent1
from sieveline.functions.vectors import euclidean
from sieveline.operators.search import recent

# --- fixed values (explanation texts of the original tool) -----------------------
SPIKE_TEXT = ("Unusual frequency spike from source '", "': ", " events in bucket (mean=", ", z-score=", ")")
ESCALATION_TEXT = ("Severity escalation detected: high/critical rate jumped from ", " to ", " in recent window")
DISTANCE_TEXT = ("Log embedding is unusually distant from cluster centroid (distance=", ")")
# ----------------------------------------------------------------------------------


def _sentence(text: tuple[str, ...], *values: Column) -> Column:
    """The values between the parts of a text (the last part ends it)."""
    heads = [F.lit(t) for t in text]
    first = heads[:len(values)]
    return F.concat(*[c for pair in zip(first, values, strict=True) for c in pair], *heads[len(values):])


ANOMALY_COLUMNS = ["log_id", "score", "is_anomaly", "explanation", "method", "method_order"]
# Result precedence on equal score: the first detector run wins.
METHOD_ORDER = {"vector_distance": 0, "frequency_zscore": 1, "severity_escalation": 2}


def _result(df: DataFrame, log_id: Column, score: Column, explanation: Column, method: str) -> DataFrame:
    return df.select(log_id.alias("log_id"), score.cast("double").alias("score"), F.lit(True).alias("is_anomaly"),
                     explanation.alias("explanation"), F.lit(method).alias("method"),
                     F.lit(METHOD_ORDER[method]).alias("method_order"))


# --- D2: frequency spikes ---------------------------------------------------------

def bucket_counts(logs: DataFrame, by: str = "source", minutes: int = 10) -> DataFrame:
    """(key, bucket, count, newest) in one hash aggregate over numbers
    (``newest`` is the last time in microseconds); map-side partial
    aggregation absorbs hot keys."""
    return logs.groupBy(F.col(by).alias("key"), minute_bucket(F.col("timestamp"), minutes).alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.max(F.unix_micros("timestamp")).alias("newest"))


def with_newest_id(logs: DataFrame, buckets: DataFrame, by: str = "source", minutes: int = 10) -> DataFrame:
    """Add ``log_id``, the newest log of each given bucket (the largest id of equal times). Logs are looked up
    for these buckets only, so pass the buckets that matter."""
    at = buckets.select(F.col("key").alias("_k"), F.col("bucket").alias("_b"), F.col("newest").alias("_n"))
    found = (logs.select(F.col(by).alias("key"), minute_bucket(F.col("timestamp"), minutes).alias("bucket"),
                         F.unix_micros("timestamp").alias("newest"), F.col("id").alias("log_id"))
             .join(at, F.col("key").eqNullSafe(F.col("_k")) & F.col("bucket").eqNullSafe(F.col("_b"))
                   & F.col("newest").eqNullSafe(F.col("_n")))
             .groupBy("_k", "_b").agg(F.max("log_id").alias("log_id")))
    return buckets.join(found, F.col("key").eqNullSafe(F.col("_k")) & F.col("bucket").eqNullSafe(F.col("_b"))).drop("_k", "_b")


def bucket_zscores(logs: DataFrame, by: str = "source", minutes: int = 10, fill_empty: bool = False) -> DataFrame:
    """A9 + W1: each bucket's z-score against its key's non-empty buckets
    (population std). The window runs on the small aggregate: one row per
    non-empty bucket of a key.

    With ``fill_empty`` (Q18) the buckets without logs between a key's first
    and last one count as zeros. No calendar is made: zeros change neither the
    sum nor the sum of squares, only the number of buckets, which follows
    from the span."""
    w = Window.partitionBy("key")
    bc = bucket_counts(logs, by, minutes)
    if not fill_empty:
        bc = bc.select("*", F.count(F.lit(1)).over(w).alias("n_buckets"), F.avg("count").over(w).alias("mean"),
                       F.stddev_pop("count").over(w).alias("std"))
        return bc.withColumn("zscore", F.when(F.col("std") != 0, (F.col("count") - F.col("mean")) / F.col("std")))
    at = F.unix_micros("bucket")
    n = ((F.max(at).over(w) - F.min(at).over(w)) / F.lit(minutes * 60_000_000)).cast("long") + 1
    total = F.sum("count").over(w)
    squares = F.sum(F.col("count").cast("double") * F.col("count")).over(w)
    bc = bc.select("*", n.alias("n_buckets"), total.alias("_t"), squares.alias("_s"))
    mean = F.col("_t") / F.col("n_buckets")
    # n * squares - total^2 is a whole number: exactly 0 where all buckets are equal.
    spread = F.col("n_buckets") * F.col("_s") - F.col("_t").cast("double") * F.col("_t")
    bc = bc.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(spread, F.lit(0.0))) / F.col("n_buckets"))
    return bc.withColumn("zscore", F.when(spread > 0, (F.col("count") - F.col("mean")) / F.col("std"))).drop("_t", "_s")


def spike_buckets(logs: DataFrame, by: str = "source", minutes: int = 10, z_threshold: float = 2.0,
                  min_logs: int = 5, min_buckets: int = 3, fill_empty: bool = False) -> DataFrame:
    """D2's buckets: z-score above the threshold, keys with at least
    ``min_buckets`` buckets and non-zero std. Nothing when fewer than
    ``min_logs`` logs are given (a scalar subquery, not a join)."""
    enough = logs.agg(F.count(F.lit(1))).scalar() >= F.lit(min_logs)
    z = bucket_zscores(logs, by, minutes, fill_empty)
    return z.where(enough & (F.col("n_buckets") >= min_buckets) & F.col("zscore").isNotNull()
                   & (F.col("zscore") > z_threshold))


def frequency_anomalies(logs: DataFrame, by: str = "source", minutes: int = 10, z_threshold: float = 2.0,
                        min_logs: int = 5, min_buckets: int = 3, fill_empty: bool = False) -> DataFrame:
    """One row per ``spike_buckets`` bucket, reported on its newest log, score min(z/5, 1)."""
    hits = with_newest_id(logs, spike_buckets(logs, by, minutes, z_threshold, min_logs, min_buckets, fill_empty), by, minutes)
    expl = _sentence(SPIKE_TEXT, F.coalesce(F.col("key"), F.lit("")), F.col("count").cast("string"),
                     fixed_text(F.col("mean"), 1), fixed_text(F.col("zscore"), 2))
    return _result(hits, F.col("log_id"), F.least(F.col("zscore") / 5.0, F.lit(1.0)), expl, "frequency_zscore")


# --- D3: severity escalation ---------------------------------------------------------

ID_PREFIX_CHARS = 4


def with_rank(logs: DataFrame, by: list[str] | None = None, bucket_minutes: int = 1) -> DataFrame:
    """Add ``rank0``, each log's place (from 0) in its group by (timestamp, id), and ``n``, the group's size.

    The exact rank is assembled without sorting a group in one task:

    * per (group, minute) counts -> running sum over minutes = rows before the minute;
    * per (group, minute, timestamp, id prefix) counts -> running sum inside the
      minute = rows before that cell (id prefixes order like the ids, so many rows
      sharing one timestamp -- e.g. a file without times stamped with its ingest
      time -- still split into up to 16^4 cells);
    * ``row_number`` inside the cell.

    The windows run on narrow count tables; the only join of the log rows is
    with the per-cell offset table.
    """
    by = list(by or [])
    cell = [*by, "_mb", "timestamp", "_idp"]
    g = logs.select("*", minute_bucket(F.col("timestamp"), bucket_minutes).alias("_mb"),
                    F.substring("id", 1, ID_PREFIX_CHARS).alias("_idp"))
    per_cell = g.groupBy(*cell).agg(F.count(F.lit(1)).alias("_c"))
    w_minute = (Window.partitionBy(*by) if by else Window.partitionBy())
    per_minute = per_cell.groupBy(*by, "_mb").agg(F.sum("_c").alias("_cm"))
    minute_off = per_minute.select(
        *by, "_mb",
        F.coalesce(F.sum("_cm").over(w_minute.orderBy("_mb").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off_m"),
        F.sum("_cm").over(w_minute).alias("n"))
    w_in_minute = Window.partitionBy(*by, "_mb").orderBy("timestamp", "_idp") \
        .rowsBetween(Window.unboundedPreceding, -1)
    cell_off = per_cell.select(*cell, F.coalesce(F.sum("_c").over(w_in_minute), F.lit(0)).alias("_off_c")) \
        .join(minute_off, [*by, "_mb"])
    w_cell = Window.partitionBy(*cell).orderBy("id")
    ranked = g.join(cell_off, cell).withColumn("_rn", F.row_number().over(w_cell))
    return ranked.withColumn("rank0", F.col("_off_m") + F.col("_off_c") + F.col("_rn") - 1) \
                 .drop("_mb", "_idp", "_rn", "_off_m", "_off_c")


def split_halves(logs: DataFrame, by: list[str] | None = None, bucket_minutes: int = 1) -> DataFrame:
    """Order logs by (timestamp, id) per group and mark the first
    n//2 as early, the rest (the odd row too) as late. Adds ``late`` and ``n``."""
    ranked = with_rank(logs, by, bucket_minutes)
    return ranked.withColumn("late", F.col("rank0") >= F.floor(F.col("n") / 2)).drop("rank0")


def escalation_stats(halves: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A10: per group early/late sizes, high counts and rates."""
    by = list(by or [])
    high = F.col("severity").isin("critical", "high")
    late = F.col("late")
    st = halves.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~late).alias("early_n"), F.count_if(late).alias("late_n"),
        F.count_if(~late & high).alias("early_high"), F.count_if(late & high).alias("late_high"))
    st = st.withColumn("early_rate", F.col("early_high") / F.greatest(F.col("early_n"), F.lit(1))) \
           .withColumn("late_rate", F.col("late_high") / F.greatest(F.col("late_n"), F.lit(1)))
    return st


def _escalation_flag(min_logs: int) -> Column:
    return ((F.col("n") >= min_logs) & (F.col("late_rate") > F.col("early_rate") * 2)
            & (F.col("late_high") >= 3))


def severity_escalation(logs: DataFrame, by: list[str] | None = None, min_logs: int = 10) -> DataFrame:
    """D3: where the late half's high/critical rate is more than twice the
    early half's and at least 3 late logs are high, every late high log is
    reported with score min(2 * (late_rate - early_rate), 1). Per group when
    ``by`` is given."""
    by = list(by or [])
    halves = split_halves(logs, by)
    stats = escalation_stats(halves, by).where(_escalation_flag(min_logs))
    late_high = halves.where(F.col("late") & F.col("severity").isin("critical", "high"))
    if by:
        hits = late_high.join(stats.select(*by, "early_rate", "late_rate"), by)
    else:
        one = stats.select(F.struct("early_rate", "late_rate").alias("s"))
        s = one.scalar()
        hits = late_high.where(s.isNotNull()).select("*", s["early_rate"].alias("early_rate"),
                                                     s["late_rate"].alias("late_rate"))
    score = F.least((F.col("late_rate") - F.col("early_rate")) * 2, F.lit(1.0))
    expl = _sentence(ESCALATION_TEXT, percent1(F.col("early_rate")), percent1(F.col("late_rate")))
    return _result(hits, F.col("id"), score, expl, "severity_escalation")


# --- D1: vector distance -----------------------------------------------------------------

def centroid(embeddings: DataFrame, col: str = "embedding") -> Column:
    """Mean vector as a scalar subquery (tree aggregate, run once)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = embeddings.select(Summarizer.mean(array_to_vector(F.col(col).cast("array<double>"))).alias("m"))
    return mean.select(vector_to_array("m")).scalar()


def centroid_distances(embeddings: DataFrame, col: str = "embedding") -> DataFrame:
    """J4 + F17: L2 distance of every vector to the centroid (no join)."""
    # The centroid is projected as a column first: subqueries may not sit
    # inside the higher-order functions that compute the distance.
    with_c = embeddings.withColumn("_centroid", centroid(embeddings, col))
    return with_c.withColumn("distance", euclidean(F.col(col), F.col("_centroid"))).drop("_centroid")


def vector_outliers(embeddings: DataFrame, threshold: float = 1.5, col: str = "embedding") -> DataFrame:
    """Vectors farther than ``threshold`` from the centroid (all vectors), farthest first."""
    far = centroid_distances(embeddings, col).where(F.col("distance") > threshold)
    return far.orderBy(F.col("distance").desc(), F.col("id").asc())


def vector_anomalies(logs: DataFrame, embeddings: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Outlying vectors whose log is among ``logs`` (J2 semi join),
    score min(distance/3, 1)."""
    out = vector_outliers(embeddings, threshold).join(logs.select("id"), "id", "left_semi")
    expl = _sentence(DISTANCE_TEXT, fixed_text(F.col("distance"), 3))
    return _result(out, F.col("id"), F.least(F.col("distance") / 3.0, F.lit(1.0)), expl, "vector_distance")


# --- D4: all detectors ------------------------------------------------------------------

def best_per_log(results: DataFrame) -> DataFrame:
    """The highest score per log id; on equal score the earlier detector."""
    w = Window.partitionBy("log_id").orderBy(F.col("score").desc(), F.col("method_order").asc())
    return results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def detect_anomalies(logs: DataFrame, as_of, minutes: int = 60, embeddings: DataFrame | None = None,
                     vector_threshold: float = 1.5, z_threshold: float = 2.0, by_source: str = "source",
                     escalation_by: list[str] | None = None) -> DataFrame:
    """Logs in ``[as_of - minutes, as_of]`` through every detector,
    one row per log id, ordered by score (L3). No row cap."""
    win = recent(logs, as_of, minutes)
    parts = []
    if embeddings is not None:
        parts.append(vector_anomalies(win, embeddings, vector_threshold))
    parts.append(frequency_anomalies(win, by=by_source, z_threshold=z_threshold))
    parts.append(severity_escalation(win, escalation_by))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return best_per_log(res).orderBy(F.col("score").desc(), F.col("log_id").asc())
