"""Document fingerprints: a homomorphic multiset hash (native DataFrame operators only).

A text is cut into paragraphs (lines) and those after sentence ends; blank
pieces do not count. Each piece is hashed to a vector, and the fingerprint is
the sum of the vectors, each lane modulo a power of two:

* lane 0 counts pieces (modulo 2^32),
* 8 dense lanes of 32 bits get something from every piece: they tell texts
  with different pieces apart,
* 6 levels of 128 sparse lanes of 16 bits: level k takes the pieces whose hash ends (above the bits used otherwise) in
  3 * k zeros, one of 8^k; a piece adds to one lane of each level that takes it, chosen by its hash.

Sums do not depend on order, and pieces can be added or taken away without
the rest of the text (``combine``). Two fingerprints differ in the sparse lanes
hit by pieces that only one of the texts has; the number of such pieces is
estimated from the share of equal lanes (linear counting) of the first level
that is not saturated, times 8^k, and likeness is the share of common pieces
that follows: 1 for equal fingerprints, 0 for no
common piece.

Defined results: null text is empty; texts without pieces have the zero
vector, and two zero vectors are alike (1.0); documents with equal ids follow
one another in the order of their text's hash; null ids come last; an empty
table gives no rows; clashing input columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.common import SPACE_CLASS, replace_columns

DENSE, HIGH, LOW = 8, 16, 8
LANES = HIGH * LOW
#: Level k has one of 2^(LEVEL_BITS * k) pieces; ZERO_FROM is the first bit of the hash that decides.
LEVELS, LEVEL_BITS, ZERO_FROM = 6, 3, 23
SPARSE = LEVELS * LANES
#: A level with fewer equal lanes is saturated (some 390 pieces that only one text has).
MIN_EQUAL = 6
#: Neighbours are found in ranges of ids with about so many rows; the ranges' bounds are collected (at most MAX_RANGES).
RANGE_ROWS, MAX_RANGES = 1000, 65_536


def with_vector(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint vector of a text column: array<long> of 1 + DENSE + SPARSE lanes."""
    pieces = (f"filter(split({text}, r'\\n|(?<=[.!?])[{SPACE_CLASS}]+'), x -> x rlike r'[^{SPACE_CLASS}]')")
    dense = ", ".join(
        f"aggregate(__h{j // 2}, 0L, (s, x) -> s + "
        + ("(x & 4294967295L)" if j % 2 else "shiftrightunsigned(x, 32)") + ") & 4294967295L" for j in range(DENSE))
    # Two steps of 16 and 8 lanes rather than one look at every piece for each of 128.
    level = (
        f"flatten(transform(transform(sequence(0, {HIGH - 1}), a -> filter(__l, x -> (x & {HIGH - 1}) = a)), "
        f"g -> transform(sequence(0, {LOW - 1}), b -> aggregate(g, 0L, (s, x) -> s + "
        f"CASE WHEN (shiftright(x, 4) & {LOW - 1}) = b THEN (shiftright(x, 7) & 65535) ELSE 0L END) & 65535L)))")
    # Each level is picked from the one before; most texts have no piece in the higher ones.
    sparse = ", ".join(f"CASE WHEN size(__l{k}) = 0 THEN array_repeat(0L, {LANES}) ELSE {level.replace('__l', f'__l{k}')} END"
                       for k in range(LEVELS))
    staged = (df.withColumn("__pieces", F.expr(pieces))
              .withColumn("__h", F.expr("transform(__pieces, x -> xxhash64(x))")))
    for j in range(DENSE // 2):
        staged = staged.withColumn(f"__h{j}", F.expr(f"transform(__pieces, x -> xxhash64(x, {j + 1}))"))
    staged = staged.withColumn("__l0", F.col("__h"))
    for k in range(1, LEVELS):
        mask = ((1 << LEVEL_BITS * k) - 1) << ZERO_FROM
        staged = staged.withColumn(f"__l{k}", F.expr(f"filter(__l{k - 1}, x -> (x & {mask}L) = 0)"))
    return (staged.withColumn(out, F.expr(f"concat(array(cast(size(__pieces) AS long), {dense}), {sparse})"))
            .drop("__pieces", "__h", *[f"__h{j}" for j in range(DENSE // 2)], *[f"__l{k}" for k in range(LEVELS)]))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the pieces of a and b together, or (sign=-1) of a without the pieces of b."""
    lanes = F.zip_with(a, b, lambda x, y: x + sign * y)
    return F.transform(lanes, lambda x, i: F.when(i <= DENSE, x.bitwiseAND(F.lit(4294967295)))
                       .otherwise(x.bitwiseAND(F.lit(65535))))


def as_text(vector: Column) -> Column:
    """The fingerprint as one lower-case hex string (8 digits per dense lane, 4 per sparse lane)."""
    return F.lower(F.array_join(F.transform(vector, lambda x, i: F.lpad(
        F.hex(x), F.when(i <= DENSE, F.lit(8)).otherwise(F.lit(4)), F.lit("0"))), ""))


def _once(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Share of common pieces of two vectors, from 0 to 1 (double)."""
    equal = F.zip_with(F.slice(a, DENSE + 2, SPARSE), F.slice(b, DENSE + 2, SPARSE), lambda x, y: x == y)
    counts = _once(equal, lambda lanes: F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(
        k.alias("k"), F.size(F.filter(F.slice(lanes, k * LANES + 1, F.lit(LANES)), lambda x: x)).alias("n"))))
    # The last level decides where all are saturated.
    level = _once(counts, lambda c: F.coalesce(F.get(F.filter(c, lambda x: x["n"] >= MIN_EQUAL), F.lit(0)),
                                               F.get(c, F.lit(LEVELS - 1))))
    total = (F.get(a, F.lit(0)) + F.get(b, F.lit(0))).cast("double")

    def share(found: Column) -> Column:
        only = F.least(total, F.log(found["n"] / F.lit(float(LANES))) / F.lit(math.log1p(-1 / LANES))
                       * F.pow(F.lit(float(1 << LEVEL_BITS)), found["k"]))
        return (F.when((found["n"] == 0) | (total == 0), F.lit(0.0))
                # Dense lanes that differ while all sparse ones agree: one piece at least is not common.
                .otherwise((total - F.greatest(only, F.lit(1.0))) / (total + F.greatest(only, F.lit(1.0)))))
    return F.when(a == b, F.lit(1.0)).otherwise(_once(level, share))


def _ranges(docs: DataFrame, doc_id: str) -> list[float]:
    """Bounds of id ranges with about RANGE_ROWS rows each (only the bounds reach the driver)."""
    n = docs.count()
    k = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    if k == 1:
        return []
    bounds = docs.select(F.percentile_approx(
        F.col(doc_id).cast("double"), [i / k for i in range(1, k)], max(10_000, 10 * k)).alias("b")).first().b
    return sorted(set(bounds or []))


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add next_<column> of the next document in descending id; after the last comes the first.

    Rows are sorted inside ranges of ids. The first row of each range also goes
    to the range before it, as the successor of its last row.
    """
    inf = float("inf")
    cut = Bucketizer(splits=[-inf, *_ranges(docs, doc_id), inf], inputCol="__order", outputCol="__range")
    keyed = (docs.withColumn("__order", F.coalesce(F.col(doc_id).cast("double"), F.lit(-inf)))
             .withColumn("__tie", F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    keyed = (cut.transform(keyed) if len(cut.getSplits()) > 2 else keyed.withColumn("__range", F.lit(0.0)))
    place = F.struct(F.col(doc_id).isNotNull().alias("s"), F.col(doc_id).alias("id"), F.col("__tie").alias("t"))
    # One row per range, at most MAX_RANGES: a proven bound for the broadcast and for the window over all.
    heads = keyed.groupBy("__range").agg(F.max(place).alias("head"))
    upward = W.orderBy("__range")
    heads = heads.select("head", F.coalesce(F.lead("__range").over(upward),
                                            F.min("__range").over(W.partitionBy())).alias("__to"))
    guests = (keyed.join(F.broadcast(heads), place == F.col("head")).drop("__range")
              .dropDuplicates(["__to"]).withColumnRenamed("__to", "__range").drop("head"))
    rows = keyed.withColumn("__guest", F.lit(0)).unionByName(guests.withColumn("__guest", F.lit(1)))
    down = W.partitionBy("__range").orderBy("__guest", F.desc_nulls_last(doc_id), F.desc("__tie"))
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(down))
    return rows.where("__guest = 0").drop("__guest", "__order", "__tie", "__range")


def edited_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add n_chars, vector, next_vector, edited (text whose second half comes from the next document), edited_vector."""
    base = replace_columns(docs, ["n_chars", "vector", "next_vector", "edited", "edited_vector"])
    filled = base.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    paired = with_next(with_vector(filled, "__t", "vector"), ["__t", "vector"], doc_id, text)
    return with_vector(
        paired.withColumn("n_chars", F.length("__t").cast("long"))
        .withColumn("edited", F.expr(
            "concat(substring(__t, 1, cast(n_chars - n_chars div 2 AS int)), "
            "substring(next___t, 1, cast(n_chars div 2 AS int)))")),
        "edited", "edited_vector").drop("__t", "next___t")
