"""BPE encoding and decoding of whole texts by tree concatenation.

Most texts are encoded where they are read. A long text is cut into segments
that are encoded in parallel by Spark and joined again:

* between pre-tokens a cut is exact as it stands, because the split pattern
  has no memory. The exception is a run of white space, whose split depends
  on what follows, so a segment never ends with one;
* one long unsplit pre-token is cut into pieces anyway. Its pieces are encoded
  apart and joined pairwise in a tree. At a join, a window of tokens on both
  sides is encoded again and doubled until its first token is the left side's
  and its last token the right side's. A sequence of BPE tokens is the
  encoding of its text if every neighbouring pair is the encoding of its own
  text; each such pair then lies in the left side, the window or the right
  side, so the join is exact.

Ids are kept as token shards store them: unsigned 32-bit little-endian
integers in one binary value.

Defined results: null text is empty and has no ids; special strings in a text
are encoded as their token; equal long texts are encoded once; repeated rows
each stay; an empty table gives no rows; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import vocab
from sieveline.llm.common import bound_batches, replace_columns

#: Texts of more characters are cut; also the length of a segment.
SEGMENT_CHARS = 32_768
#: Tokens on each side of a join that are encoded again first.
FIRST_WINDOW = 8
LE32 = np.dtype("<u4")


def pack(ids) -> bytes:
    return np.asarray(ids, dtype=LE32).tobytes()


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype=LE32).tolist()


def cut(coder: vocab.Coder, text: str, size: int) -> Iterator[tuple[str, str]]:
    """Segments of a text as (kind, text): 'text' is encoded as a text, 'token' is one whole pre-token or its
    first piece, 'more' continues the pre-token before it, 'special' is a special token."""
    for part, special in coder.parts(text):
        if special is not None:
            yield "special", part
            continue
        spans: list[tuple[int, int]] = []  # pre-tokens of the segment so far
        for a, b in coder.spans(part):
            if spans and b - spans[0][0] > size:
                yield from _segment(coder, part, spans)
                spans = []
            if b - a > size:
                yield "token", part[a:a + size]
                yield from (("more", part[i:min(i + size, b)]) for i in range(a + size, b, size))
            else:
                spans.append((a, b))
        if spans:
            yield "text", part[spans[0][0]:spans[-1][1]]


def _segment(coder: vocab.Coder, part: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, str]]:
    """A segment that more text follows; white space at its end goes by pre-tokens, as the whole text splits it."""
    n = len(spans)
    while n and coder.space.fullmatch(part, *spans[n - 1]):
        n -= 1
    if n:
        yield "text", part[spans[0][0]:spans[n - 1][1]]
    yield from (("token", part[a:b]) for a, b in spans[n:])


def join(coder: vocab.Coder, left: list[int], right: list[int], window: int = FIRST_WINDOW) -> list[int]:
    """Encoding of one pre-token from the encodings of its two parts."""
    if not left or not right:
        return left + right
    k = window
    while True:
        a, b = left[-k:], right[:k]
        ids = coder.merge(coder.to_bytes(a + b))
        if (k >= len(left) or ids[0] == a[0]) and (k >= len(right) or ids[-1] == b[-1]):
            return left[:-k] + ids + right[k:]
        k *= 2


def join_all(coder: vocab.Coder, pieces: list[list[int]]) -> list[int]:
    """Join neighbouring pieces of one pre-token pairwise until one is left."""
    while len(pieces) > 1:
        pieces = [join(coder, *pieces[i:i + 2]) if i + 1 < len(pieces) else pieces[i]
                  for i in range(0, len(pieces), 2)]
    return pieces[0] if pieces else []


def encode_segment(coder: vocab.Coder, kind: str, text: str) -> list[int]:
    if kind == "special":
        return [coder.special[text]]
    return coder.encode_ordinary(text) if kind == "text" else coder.merge(text)


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None,
           segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Add token_ids (binary) and n_tokens (long)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = vocab.share(spark, vocabulary)

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = vocab.coder_of(shared)
        for texts in batches:
            yield pd.Series([pack(coder.encode(x or "")) for x in texts], dtype=object)

    def segments(batches):
        coder = vocab.coder_of(shared)
        for pdf in batches:
            for key, whole in zip(pdf["__key"], pdf["__text"], strict=True):
                found = list(cut(coder, whole, segment_chars))
                yield pd.DataFrame({"__key": key, "__seq": range(len(found)), "__kind": [k for k, _ in found],
                                    "__piece": [x for _, x in found]})

    def coded(batches):
        coder = vocab.coder_of(shared)
        for pdf in batches:
            ids = [pack(encode_segment(coder, k, x)) for k, x in zip(pdf["__kind"], pdf["__piece"], strict=True)]
            yield pd.DataFrame({"__key": pdf["__key"], "__seq": pdf["__seq"], "__kind": pdf["__kind"], "__ids": ids})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        coder = vocab.coder_of(shared)
        pdf = pdf.sort_values("__seq")
        runs: list[list[bytes]] = []
        for kind, ids in zip(pdf["__kind"], pdf["__ids"], strict=True):
            if kind == "more":
                runs[-1].append(ids)
            else:
                runs.append([ids])
        whole = b"".join(r[0] if len(r) == 1 else pack(join_all(coder, [unpack(x) for x in r])) for r in runs)
        return pd.DataFrame({"__key": pdf["__key"].iloc[:1], "__ids": [whole]})

    base = replace_columns(docs, ["token_ids", "n_tokens"])
    keep = [F.col(f"`{c}`") for c in base.columns]
    is_long = F.coalesce(F.length(text) > segment_chars, F.lit(False))
    short = base.where(~is_long).withColumn("token_ids", encoded(F.col(text)))
    long = base.where(is_long).withColumn("__key", F.sha2(text, 256))
    ids = (
        long.select("__key", F.col(text).alias("__text")).dropDuplicates(["__key"])
        .mapInPandas(segments, "__key string, __seq long, __kind string, __piece string")
        .repartition("__key", "__seq")
        .mapInPandas(coded, "__key string, __seq long, __kind string, __ids binary")
        .groupBy("__key").applyInPandas(joined, "__key string, __ids binary"))
    long = long.join(ids, "__key").withColumn("token_ids", F.col("__ids"))
    return (short.select(*keep, "token_ids").unionByName(long.select(*keep, "token_ids"))
            .withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long")))


def decode(tokens: DataFrame, ids: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """Add decoded_text; special tokens are written out, invalid bytes become U+FFFD. Null ids decode to ''."""
    spark = tokens.sparkSession
    bound_batches(spark)
    shared = vocab.share(spark, vocabulary)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = vocab.coder_of(shared)
        for packed in batches:
            yield pd.Series([coder.to_bytes(unpack(x or b"")).decode("utf-8", "replace") for x in packed],
                            dtype=object)

    base = replace_columns(tokens, ["decoded_text"])
    return base.withColumn("decoded_text", decoded(F.col(ids)))
