"""Target-distribution importance resampling of documents over hashed n-grams.

Features are the runs of 1 to 2 consecutive words of a text, lower-cased; a
feature's bucket is its CRC-32 modulo ``BUCKETS``. Corpus and target are
counted per bucket; a bucket's gain is the log-ratio of its smoothed shares in
thousandths, a document's weight the mean gain of its features. Gumbel noise
that depends on the document's id alone turns the weights into draws without
replacement: the documents with the highest scores are taken.

N-grams of a batch are interned in an open-addressed table (numpy): the slot of
an n-gram starts at its xxhash64 and moves on while another key, or the same
key with other bytes, holds the slot. A slot stores bucket and count, so the
checksum is computed once per distinct n-gram of a batch; occurrences keep the
number of their slot, by which counts are summed and gains gathered.

Counts of the whole corpus travel as at most ``BUCKETS`` numbers. Ranks come
from the number of documents at each score (scores are whole numbers of a
bounded range, the noise spreads documents over thousands of them) and the
order inside a score, so there is no global sort.

Defined results: null or empty text and text without words have no features
and weight 0; the noise of a null id comes from the text's digest; ties go to
the smaller id, null last, rows equal in score and id in an order fixed when
the scores are written; an empty table gives no rows, an empty target is a
target without features; clashing input columns are replaced.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import bound_batches, replace_columns, written
from sieveline.llm.plainwords import words_of

#: Fixed values of the features and of the draw.
BUCKETS = 10_000
NGRAM = 2
SEED = 7
PERCENT = 25
MIN_WORDS = 20
#: Words whose n-grams are interned together; a longer text is a batch of its own.
BATCH_WORDS = 200_000

WEIGHED = [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]
OUT = [f.name for f in WEIGHED] + ["score", "rank"]


class NgramTable:
    """Distinct n-grams of a batch: ``slot`` of each occurrence, ``bucket`` and ``count`` of each slot."""

    def __init__(self, grams: list[bytes], buckets: int = BUCKETS, hash_of=None):
        import zlib

        import numpy as np
        import xxhash
        n = len(grams)
        size = 1 << max(4, (2 * n).bit_length())
        keys = np.fromiter(map(hash_of or xxhash.xxh64_intdigest, grams), dtype=np.uint64, count=n)
        names = np.empty(n, dtype=object)
        names[:] = grams
        holder = np.full(size, -1, dtype=np.int64)  # the occurrence whose n-gram a slot holds
        self.slot = (keys & np.uint64(size - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            s = self.slot[left]
            free = holder[s] < 0
            holder[s[free]] = left[free]
            held = holder[s]
            same = keys[held] == keys[left]
            same[same] = (names[held[same]] == names[left[same]]).astype(bool)
            left = left[~same]
            self.slot[left] = (self.slot[left] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)
        used = np.flatnonzero(holder >= 0)
        self.bucket = np.zeros(size, dtype=np.int64)
        self.bucket[used] = [zlib.crc32(g) % buckets for g in names[holder[used]]]


def grams_of(words: list[bytes], longest: int = NGRAM) -> list[bytes]:
    return [g for k in range(1, longest + 1) for g in
            (words if k == 1 else map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))]


def _parts(texts: list[list[bytes]]):
    """Stretches of consecutive texts of about BATCH_WORDS words."""
    start = held = 0
    for i, words in enumerate(texts):
        held += len(words)
        if held >= BATCH_WORDS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def count_buckets(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket."""
    bound_batches(docs.sparkSession)

    def count(batches):
        import numpy as np
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            texts = [words_of(x) for x in batch.column(0).cast(pa.binary()).to_pylist()]
            for a, b in _parts(texts):
                table = NgramTable([g for words in texts[a:b] for g in grams_of(words)], buckets)
                np.add.at(total, table.bucket, table.count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = (docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most ``buckets`` rows
    out = [0] * buckets
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Log-ratio of each bucket's smoothed shares in target and corpus, in thousandths, rounded down."""
    b, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b))))
            for s, t in zip(corpus, target, strict=True)]


def weigh(docs: DataFrame, gain: list[int], text: str = "text") -> DataFrame:
    """The documents with n_words, n_features and weight, the mean gain of the features rounded down."""
    bound_batches(docs.sparkSession)
    base = replace_columns(docs, OUT)

    def weighed(batches):
        import numpy as np
        gain_of = np.array(gain, dtype=np.int64)
        for batch in batches:
            texts = [words_of(x) for x in batch.column(text).cast(pa.binary()).to_pylist()]
            n_features, weight = [], []
            for a, b in _parts(texts):
                grams = [grams_of(words) for words in texts[a:b]]
                ends = np.cumsum([0, *map(len, grams)])
                table = NgramTable([g for of_text in grams for g in of_text], len(gain))
                so_far = np.concatenate([[0], np.cumsum(gain_of[table.bucket][table.slot])])
                n = np.diff(ends)
                n_features.append(n)
                weight.append((so_far[ends[1:]] - so_far[ends[:-1]]) // np.maximum(n, 1))
            added = [np.array([len(w) for w in texts], dtype=np.int64),
                     *(np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (n_features, weight))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)],
                                             names=[*batch.schema.names, *[f.name for f in WEIGHED]])

    return base.mapInArrow(weighed, T.StructType([*base.schema.fields, *WEIGHED]))


def noise(doc_id: Column, text_digest: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise of a document in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text_digest)), 256),
                           1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, doc_id: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS,
         digest: str | None = None, seed: int = SEED) -> DataFrame:
    """Adds score and rank: 1, 2, ... for the drawn ``percent`` of the documents of at least ``min_words`` words.

    ``digest`` names a column that stands for a null id; what is given is written once.
    """
    score = F.col("weight") + noise(F.col(doc_id), F.col(digest) if digest else F.lit(""), seed)
    rows = written(weighed.withColumn("score", score).withColumn("__row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= min_words
    at_score = rows.where(able).groupBy(F.col("score").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    # One row for each whole number that is a score.
    down = W.orderBy(F.col("__s").desc())
    placed = (at_score.withColumn("__above", F.sum("__n").over(down) - F.col("__n"))
              .withColumn("__most", F.floor(percent * F.sum("__n").over(W.partitionBy()) / 100)))
    placed = at_score.sparkSession.createDataFrame([], placed.schema) if percent <= 0 else placed
    open_ = placed.where("__above < __most")
    joined = rows.join(open_, able & (F.col("score") == F.col("__s")), "left")
    order = W.partitionBy("score").orderBy(F.col(doc_id).asc_nulls_last(), "__row")
    rank = F.col("__above") + F.row_number().over(order)
    ranked = (joined.where(F.col("__s").isNotNull()).withColumn("rank", rank)
              .withColumn("rank", F.when(F.col("rank") <= F.col("__most"), F.col("rank"))))
    rest = joined.where(F.col("__s").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("__s", "__n", "__above", "__most", "__row")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
             min_words: int = MIN_WORDS) -> DataFrame:
    """The drawn documents, best first in ``rank``."""
    gain = gains(count_buckets(docs, text), count_buckets(target, text))
    weighed = weigh(docs, gain, text).withColumn("__digest", F.md5(F.coalesce(F.col(text), F.lit(""))))
    return draw(weighed, doc_id, percent, min_words, "__digest").where("rank IS NOT NULL").drop("__digest")
