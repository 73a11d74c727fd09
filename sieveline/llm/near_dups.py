"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

Texts become sets of 5-word shingles. Documents with equal sets are one node
of the graph from the start, so copies are never expanded into pairs. Each
node gets a SuperMinHash signature; nodes that agree in a band are candidates.

Within a band's bucket not all pairs are made. In each round the smallest
node of the bucket (later: of each of a growing number of slices of it) is
compared with the members that are not yet in its component: inside the join
by an exact bound and by two bits of each signature value, then on the full
sets. The bound: shingles that only one of all candidates has cannot be
common, so a pair shares at most the smaller number of other shingles. It
rejects texts that differ in new words without looking at their sets.
A pair is compared only in the bucket of the first band that it shares, so near
copies that share most of their buckets are not made once for each.
Confirmed pairs are joined by union-find. A compared node leaves the bucket, and a
bucket is done once all its members are in one component or have left. So
every pair that shares a bucket is compared, in the first one that it shares,
or already connected: there is no cap on buckets, and a bucket of copies takes
one round.

With 32 bands of 4 rows a pair at similarity 0.75 is a candidate with
probability above 0.99999; the two-bit test loses it with less than 1e-5.

Defined results: null or empty text, or text without words, has an empty set
and is linked with nothing; fewer than 5 words are one shingle; documents
equal in id and text are one; a null id is smaller than none (a component of
null ids alone has component_id null, and keeps its rows); an empty table
gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import bound_batches, remove_written, replace_columns, written
from sieveline.llm.components import stars

BANDS, ROWS = 32, 4
PERCENT = 75
#: Signature values of the two-bit sketch; bands use the first of them.
VALUES = 512
#: Slices of a bucket per round: 1, then GROWTH times as many each round.
GROWTH = 16


def with_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def _lists(values, lengths, kind) -> pa.Array:
    import numpy as np
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS,
           rows: int = ROWS, values: int = VALUES) -> DataFrame:
    """(__id, __hash, __node, __n, __bands, __sketch) of each document: its set's hash, size, band keys and two-bit
    sketch. ``values`` is a multiple of 32 and at least ``bands * rows``."""
    bound_batches(docs.sparkSession)
    narrow = with_hash(docs, text).select(F.col(doc_id).cast("long").alias("__id"), "__hash",
                                          F.col(text).alias("__text"))

    def sign(batches):
        import numpy as np

        from sieveline.llm import superminhash as smh
        hashes = smh.WordHashes()
        for batch in batches:
            sets = [smh.shingle_set(t, hashes) for t in _texts(batch.column("__text"))]
            sigs = smh.signatures(sets, values)
            keys, sketch = smh.band_keys(sigs, bands, rows), smh.two_bit_sketch(sigs)
            full = np.array([len(s) > 0 for s in sets], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__hash"),
                 pa.array([smh.set_hash(s) for s in sets], type=pa.int64()),
                 pa.array([len(s) for s in sets], type=pa.int64()),
                 _lists(keys[full].reshape(-1), full * bands, pa.int64()),
                 _lists(sketch.reshape(-1), [sketch.shape[1]] * len(sets), pa.int64())],
                names=["__id", "__hash", "__node", "__n", "__bands", "__sketch"])

    return narrow.mapInArrow(sign, "__id long, __hash long, __node long, __n long, __bands array<long>, "
                                   "__sketch array<long>")


def shingled(docs: DataFrame) -> DataFrame:
    """(__node, __set) of (__node, __text) rows."""
    def shingle(batches):
        from sieveline.llm import superminhash as smh
        hashes = smh.WordHashes()
        for batch in batches:
            sets = [smh.shingle_set(t, hashes).view("int64") for t in _texts(batch.column("__text"))]
            flat = pa.concat_arrays([pa.array(s) for s in sets]) if sets else pa.array([], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__node"), _lists(flat, [len(s) for s in sets], pa.int64())], names=["__node", "__set"])

    return docs.select("__node", "__text").mapInArrow(shingle, "__node long, __set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""
    a = sets.select(F.col("__node").alias("a"), F.col("__set").alias("__x"))
    b = sets.select(F.col("__node").alias("b"), F.col("__set").alias("__y"))
    return (pairs.join(a, "a").join(b, "b")
            .withColumn("both", F.size(F.array_intersect("__x", "__y")))
            .where(F.expr(f"100 * both >= {percent} * (size(__x) + size(__y) - both)")).select("a", "b"))


#: Columns of a bucket's members: the band that the key belongs to, and the keys of all bands of the node.
BUCKET = ["key", "band", "node", "n", "common", "sketch", "bands"]


def with_common(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members with common, how many of a node's shingles another candidate has too; nodes that are too few of them
    to be similar to anything are left out. Shingles are counted before any node meets another."""
    alone = (sets.select("__node", F.explode("__set").alias("x"))
             .groupBy("x").agg(F.count("*").alias("c"), F.min("__node").alias("__node")).where("c = 1")
             .groupBy(F.col("__node").alias("node")).agg(F.count("*").alias("alone")))
    return (members.join(alone, "node", "left").withColumn("common", F.expr("n - coalesce(alone, 0L)"))
            .where(f"100 * common >= {percent} * n").select(*BUCKET))


def _differences(words: int) -> str:
    """SQL for the number of two-bit values in which the sketches of a member and a pivot differ."""
    apart = "(get(sketch, {i}) ^ get(pivot_sketch, {i}))"
    return " + ".join(f"bit_count(({a} | shiftrightunsigned({a}, 1)) & 6148914691236517205L)"
                      for a in (apart.format(i=i) for i in range(words)))


def _shared_before(bands: int) -> str:
    """SQL: a member and a pivot share a band before this bucket's."""
    return " OR ".join(["false", *(f"band > {i} AND get(bands, {i}) = get(pivot_bands, {i})" for i in range(bands - 1))])


def links(docs: DataFrame, classes: DataFrame, members: DataFrame, doc_id: str, text: str,
          percent: int = PERCENT, values: int = VALUES, bands: int = BANDS) -> DataFrame | None:
    """(node, root) of linked nodes above their root; ``members`` is a written (key, band, node, n, sketch, bands) table
    of bucket members, ``values`` the length of a signature."""
    from sieveline.llm.superminhash import most_differences
    if members.isEmpty():
        return None
    # The text of one document per candidate node; documents are found by id, then checked by hash.
    wanted = (classes.join(members.select("node").distinct(), F.col("__node") == F.col("node"), "left_semi")
              .select(F.col("__rep").alias("__i"), F.col("__rep_hash").alias("__h"), "__node"))
    texts = with_hash(docs, text).select(F.col(doc_id).cast("long").alias("__id"), "__hash", F.col(text).alias("__text"))
    chosen = texts.join(wanted, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")))
    sets = written(shingled(chosen).dropDuplicates(["__node"]), "near-sets")

    alike = f"{_differences(values // 32)} <= {most_differences(values, percent / 100)}"
    bound = f"100 * least(common, pivot_common) >= {percent} * (n + pivot_n - least(common, pivot_common))"
    first_here = f"NOT ({_shared_before(bands)})"
    labels = before = tested = None
    slices, bucket = 1, written(with_common(members, sets, percent), "near-common")
    while True:
        if labels is None:
            here = bucket.withColumn("label", F.col("node"))
        else:
            known = labels.toDF("__l", "__root")
            here = (bucket.join(known, F.col("node") == F.col("__l"), "left")
                    .select(*BUCKET, F.coalesce("__root", "node").alias("label")))
        mixed = (here.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                 .where("lo <> hi").select("key"))
        here = written(here.join(mixed, "key", "left_semi"), "near-open")
        if before is not None:
            remove_written(before)
        if here.isEmpty():
            return labels
        sliced = here.withColumn("slice", F.expr(f"pmod(xxhash64(node, {slices}), {slices})"))
        first = sliced.groupBy("key", "slice").agg(
            F.min(F.struct("node", "label", "n", "common", "sketch", "bands")).alias("p")).select("key", "slice", "p.*")
        pivots = first.drop("slice").toDF("key", "pivot", "pivot_label", "pivot_n", "pivot_common", "pivot_sketch", "pivot_bands")
        # Of two pivots the larger is compared as a member.
        own = first.select("key", "slice", F.col("node").alias("own"))
        pairs = (sliced.join(own, ["key", "slice"]).join(pivots, "key")
                 .where(f"(node > pivot OR node <> own) AND node <> pivot AND label <> pivot_label AND {bound} AND {alike} "
                        f"AND {first_here}")
                 .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = written(_verified(pairs, sets, percent), "near-links")
        if not found.isEmpty():
            labels = stars(found if labels is None else found.union(labels))
        bucket = (here.join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti")
                  .select(*BUCKET))
        before = here
        slices *= GROWTH


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, __hash, n_shingles, component_id, kept), one row per document."""
    signs = written(signed(docs, doc_id, text, bands, rows), "near-signatures")
    node = signs.where("__n > 0").groupBy("__node").agg(
        F.min(F.struct(F.coalesce("__id", F.lit((1 << 63) - 1)).alias("o"), "__id", "__hash")).alias("r"),
        # Equal for all documents of a node.
        F.max("__n").alias("__n"), F.first("__bands").alias("__bands"), F.first("__sketch").alias("__sketch"))
    classes = written(node.select("__node", F.col("r.__id").alias("__rep"), F.col("r.__hash").alias("__rep_hash"),
                                  "__n", "__bands", "__sketch"), "near-classes")
    keys = classes.select(F.col("__node").alias("node"), F.posexplode("__bands").alias("band", "key"))
    shared = (keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
              .where("lo <> hi").select("key"))
    members = written(
        keys.join(shared, "key", "left_semi")
        .join(classes.select(F.col("__node").alias("node"), F.col("__n").alias("n"), F.col("__sketch").alias("sketch"),
                             F.col("__bands").alias("bands")),
              "node"), "near-members")
    labels = links(docs, classes, members, doc_id, text, percent, bands=bands)
    if labels is None:
        ids = classes.select("__node", F.col("__rep").alias("component_id"))
    else:
        known = labels.toDF("__l", "__root")
        rooted = (classes.join(known, F.col("__node") == F.col("__l"), "left")
                  .select("__node", "__rep", F.coalesce("__root", "__node").alias("__root")))
        smallest = rooted.groupBy("__root").agg(F.min("__rep").alias("component_id"))
        ids = rooted.join(smallest, "__root").select("__node", "component_id")
    ids = ids.withColumnRenamed("__node", "__c")
    return (signs.drop("__bands", "__sketch").join(ids, F.col("__node") == F.col("__c"), "left")
            .withColumn("component_id", F.when(F.col("__n") == 0, F.col("__id")).otherwise(F.col("component_id")))
            .select(F.col("__id").alias("doc_id"), "__hash", F.col("__n").alias("n_shingles"), "component_id",
                    F.col("__id").eqNullSafe(F.col("component_id")).alias("kept")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with one of each group left, the one with the smallest id; of equal rows one stays."""
    kept = written(near_duplicates(docs, doc_id, text, percent).where("kept")
                   .select(F.col("doc_id").alias("__i"), F.col("__hash").alias("__h")).distinct(), "near-kept")
    base = with_hash(replace_columns(docs, ["__hash"]), text)
    return (base.join(kept, base[doc_id].cast("long").eqNullSafe(kept["__i"]) & (base["__hash"] == kept["__h"]),
                      "left_semi")
            .dropDuplicates([doc_id, "__hash"]).drop("__hash"))
