"""Mixing sources to target weights by a low-discrepancy schedule (native DataFrame operators only).

Targets. Sources, in code point order with null last, take turns at the
weights; they share a percentage of all words in proportion to them. A target
stops at ``cap`` times its source's size, and the excess is shared again by
weight until none is above (solved exactly, in integers, from running sums).

Blocks. The documents of a source, in the order of a hash, form a stream of
words that is cut into equal blocks; past its end the stream begins again.

Schedule. Point i of the van der Corput sequence in base 2 is mapped through
the cumulative number of blocks that each source needs. Over one period every
number below 2^m comes up exactly once, so every source gets exactly its
number of slots and any part of the schedule has nearly the right mixture.
The slots of a source, ranked in schedule order, take its blocks, whose
documents the hash has shuffled; the last block is cut at the target. A
document stands in the mixture where the block that it begins in has its slot,
so any part of what ``mixture`` writes has nearly the right mixture too.

Running sums over documents use about sqrt(n) hash buckets per source, so no
task sees more than about sqrt(n) rows of one source, however hot it is.

Defined results: null text has no words; documents without words are never
taken; repeated rows are placed one after the other; a null source is a
source; an empty table gives no rows; clashing input columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.common import SPACE_CLASS, count_words, replace_columns, written

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
CAP = 2
#: Words of a block (one slot of the schedule).
BLOCK_WORDS = 4096
#: Points per cell when points look up their source; slots per chunk when they are ranked.
CELL_BITS, CHUNK_BITS = 6, 10
#: Cells are listed through groups of so many, so that no array grows with a source by more than a row per group.
GROUP_BITS = 10
HASH_BITS = 40

PLACED = ["size", "source_size", "target", "taken", "slots"]


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add size (words) and __h (order inside the source, from document id and text)."""
    return (replace_columns(docs, ["size", "__h"]).withColumn("size", count_words(F.col(text)))
            .withColumn("__h", _key(doc_id, text)))


def _key(doc_id: str, text: str) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
                             F.md5(F.coalesce(F.col(text), F.lit("")))))


def targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS,
            share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """One row per source: __sid, source, n_docs, source_size, target (double), __words (whole words to take).

    The windows without a partition run over this table of sources, not over documents.
    """
    by_source = sizes.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = (by_source
              .withColumn("__sid", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
              .withColumn("__w", F.expr(f"element_at(array({','.join(map(str, weights))}), "
                                        f"cast(__sid % {len(weights)} AS int) + 1)").cast("long"))
              .withColumn("__cap", cap * F.col("source_size"))
              .withColumn("__all", F.sum("source_size").over(W.partitionBy())))
    by_ratio = W.orderBy(F.col("__cap") / F.col("__w"), "__sid")
    share = f"{share_percent} * __all"
    filled = (
        ranked
        .withColumn("__before", F.coalesce(F.sum("__cap").over(
            by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__from", F.sum("__w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("__full", F.expr(f"({share} - 100 * __before) * __w >= 100 * __cap * __from"))
        .withColumn("__full_caps", F.sum(F.expr("CASE WHEN __full THEN __cap ELSE 0 END")).over(W.partitionBy()))
        .withColumn("__open_w", F.sum(F.expr("CASE WHEN __full THEN 0 ELSE __w END")).over(W.partitionBy()))
        .withColumn("target", F.expr(
            f"CASE WHEN __full THEN cast(__cap AS double) ELSE cast(__w * ({share} - 100 * __full_caps) AS double) "
            "/ cast(100 * __open_w AS double) END"))
        .withColumn("__words", F.floor("target").cast("long")))
    return written(filled.select("__sid", "source", "n_docs", "source_size", "target", "__words"), "mix-targets")


def schedule(goal: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mixture in order: slot, __sid, block (rank of the slot within its source)."""
    spark = goal.sparkSession
    need = goal.select("__sid", F.expr(f"cast(ceil(__words / {block_words}) AS long)").alias("n")).where("n > 0")
    need = (need.withColumn("hi", F.sum("n").over(W.orderBy("__sid"))).withColumn("lo", F.expr("hi - n")))
    blocks = need.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(1, (blocks - 1).bit_length())
    points = (spark.range(1 << bits)
              .select(F.col("id").alias("slot"),
                      F.expr(f"cast(conv(reverse(lpad(bin(id), {bits}, '0')), 2, 10) AS long)").alias("v"))
              .where(F.col("v") < blocks).withColumn("cell", F.expr(f"shiftright(v, {CELL_BITS})")))
    wide = CELL_BITS + GROUP_BITS
    groups = need.select("__sid", "lo", "hi", F.explode(F.expr(
        f"sequence(shiftright(lo, {wide}), shiftright(hi - 1, {wide}))")).alias("g"))
    cells = groups.select("__sid", "lo", "hi", F.explode(F.expr(
        f"sequence(greatest(shiftright(lo, {CELL_BITS}), shiftleft(g, {GROUP_BITS})), "
        f"least(shiftright(hi - 1, {CELL_BITS}), shiftleft(g + 1, {GROUP_BITS}) - 1))")).alias("cell"))
    slots = (points.join(cells, "cell").where("v >= lo AND v < hi")
             .select("slot", "__sid", F.expr(f"shiftright(slot, {CHUNK_BITS})").alias("chunk")))
    per_chunk = slots.groupBy("__sid", "chunk").agg(F.count("*").alias("n"))
    before = per_chunk.withColumn("before", F.sum("n").over(W.partitionBy("__sid").orderBy("chunk")) - F.col("n"))
    in_chunk = F.row_number().over(W.partitionBy("__sid", "chunk").orderBy("slot")) - 1
    return (slots.withColumn("k", in_chunk).join(before.drop("n"), ["__sid", "chunk"])
            .select("slot", "__sid", (F.col("before") + F.col("k")).cast("long").alias("block")))


def placed(sizes: DataFrame, goal: DataFrame, source: str = "source") -> DataFrame:
    """Add __sid, source_size, target, __words and __start (first word in the source's stream) to sized documents."""
    g = goal.withColumnRenamed("source", "__source")
    docs = (sizes.join(g, sizes[source].eqNullSafe(g["__source"])).drop("__source")
            .withColumn("__bucket", F.expr(
                f"shiftright(cast(conv(substr(__h, 1, {HASH_BITS // 4}), 16, 10) AS long) "
                f"* cast(ceil(sqrt(n_docs)) AS long), {HASH_BITS})")))
    # Only the summed column of the running sums of buckets is kept, so this branch reads no text column twice.
    per_bucket = docs.groupBy("__sid", "__bucket").agg(F.sum("size").alias("__n"))
    before = per_bucket.select(
        F.col("__sid").alias("__s"), F.col("__bucket").alias("__b"),
        (F.sum("__n").over(W.partitionBy("__sid").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    inside = W.partitionBy("__sid", "__bucket").orderBy("__h", "size").rowsBetween(W.unboundedPreceding, 0)
    return (docs.withColumn("__end", F.sum("size").over(inside))
            .join(before, (F.col("__sid") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
            .withColumn("__start", F.expr("__before + __end - size"))
            .drop("__s", "__b", "__before", "__end", "__bucket", "n_docs"))


def segments(places: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS, cap: int = CAP) -> DataFrame:
    """What each slot takes: slot, __sid, __start (the document), epoch, from_word, to_word (within the document), word
    (of the block)."""
    b = block_words
    pieces = (
        places.where("size > 0").select("__sid", "__start", "size", "source_size", "__words")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
        .withColumn("p", F.expr("__start + epoch * source_size"))
        .withColumn("q", F.expr("least(p + size, __words)")).where("q > p")
        .withColumn("block", F.explode(F.expr(f"sequence(p div {b}, (q - 1) div {b})"))))
    return (pieces.join(slots, ["__sid", "block"])
            .select("slot", "__sid", "__start", "epoch", F.expr(f"greatest(p, block * {b}) - p").alias("from_word"),
                    F.expr(f"least(q, (block + 1) * {b}) - p").alias("to_word"),
                    F.expr(f"greatest(p - block * {b}, 0)").alias("word")))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP,
        block_words: int = BLOCK_WORDS, sizes: DataFrame | None = None) -> DataFrame:
    """All documents with size, source_size, target (of the source), taken (words, repeats counted) and slots (where
    in the mixture each taking begins, as (slot, word of the block)).

    ``sizes`` may pass ``sized(docs)`` that was written before, to count words once.
    """
    sizes = sized(docs, text, doc_id) if sizes is None else sizes
    return _taken(sizes, source, weights, share_percent, cap, block_words).drop("__h")


def _taken(sizes: DataFrame, source: str, weights: tuple[int, ...], share_percent: int, cap: int,
           block_words: int) -> DataFrame:
    goal = targets(sizes, source, weights, share_percent, cap)
    places = placed(replace_columns(sizes, PLACED[1:]), goal, source)
    # Written, like the takings: one plan for all would be held and told of by the driver again after each of its shuffles.
    slots = written(schedule(goal, block_words), "mix-slots")
    took = (segments(places, slots, block_words, cap)
            .groupBy(F.col("__sid").alias("__s"), F.col("__start").alias("__p"))
            .agg(F.sum(F.col("to_word") - F.col("from_word")).alias("__taken"),
                 # At most ``cap`` takings begin; in order.
                 F.array_sort(F.collect_list(F.when(F.col("from_word") == 0, F.struct("epoch", "slot", "word")))).alias("__at")))
    joined = places.join(took, (F.col("__sid") == F.col("__s")) & (F.col("__start") == F.col("__p")), "left")
    return (joined.withColumn("taken", F.expr("CASE WHEN size > 0 THEN coalesce(__taken, 0L) ELSE 0L END"))
            .withColumn("slots", F.expr("CASE WHEN size > 0 THEN transform(__at, x -> struct(x.slot, x.word)) END"))
            .drop("__s", "__p", "__taken", "__at", "__sid", "__start", "__words"))


def mixture(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
            weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP,
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of the mixture, with the columns of ``docs``, in the order of the schedule (that in which they are
    written): a document taken n times over gives n rows, and a row with its first words for the rest.

    Everything is decided without the texts; each text then meets its takings once. Rows equal in id, source and
    text are taken from one of them.
    """
    base = replace_columns(docs, ["__h", "__of", "__w", "__at", "__size"])

    def of(h: Column, src: Column) -> Column:
        return F.concat_ws("|", h, src.isNull().cast("string"), src)
    sizes = written(sized(base, text, doc_id).select(F.col(source).alias("source"), "size", "__h"), "mix-sizes")
    mixed = _taken(sizes, "source", weights, share_percent, cap, block_words)
    takes = mixed.where("taken > 0").select(of(F.col("__h"), F.col("source")).alias("__of"), F.col("size").alias("__size"), "slots", F.posexplode(F.expr(COPIES)).alias("__k", "__w"))
    takes = written(takes.select("__of", "__size", "__w", F.expr("get(slots, __k)").alias("__at")), "mix-takes")
    texts = base.withColumn("__of", of(_key(doc_id, text), F.col(source))).dropDuplicates(["__of"])
    rows = texts.join(takes, "__of").orderBy("__at", "__of")
    return rows.withColumn(text, F.when(F.col("__w") < F.col("__size"), _first_words(text)).otherwise(F.col(text))) \
               .select(*[F.col(f"`{c}`") for c in docs.columns])


#: Words of each taking of a document.
COPIES = "transform(sequence(0L, (taken - 1) div size), i -> least(size, taken - i * size))"


def _first_words(text: str) -> Column:
    """The first __w words of a text, with its own white space."""
    return F.expr(rf"array_join(slice(split({text}, r'(?<=[{SPACE_CLASS}])(?=[^{SPACE_CLASS}])'), 1, "
                  rf"cast(__w AS int) + CASE WHEN {text} rlike r'^[{SPACE_CLASS}]+[^{SPACE_CLASS}]' "
                  "THEN 1 ELSE 0 END), '')")


def emit(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The texts of rows with size and taken, in no order: a document taken n times over gives n rows, and a row with its
    first words for the rest."""
    return (mixed.where("taken > 0").withColumn("__w", F.explode(F.expr(COPIES)))
            .withColumn(text, F.when(F.col("__w") < F.col("size"), _first_words(text)).otherwise(F.col(text))).drop("__w"))
