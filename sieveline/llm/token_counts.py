"""Token counts with the whole-token shortcut.

Offline, on the driver, every vocabulary string that is one pre-token and
encodes alone as one token is proved and collected. Counting then splits a
text into pre-tokens, counts those in the proved set as one each, and merges
only the rest (remembering the counts of recent ones in a bounded table).

Defined results: null text counts as empty, which has 0 tokens; special
strings inside a text count as one token, as the library's default does;
repeated rows each count; very long pre-tokens are merged whole; an empty
table gives no rows; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import vocab
from sieveline.llm.common import bound_batches, replace_columns

#: Pre-tokens whose merged count a worker remembers; longer ones than MAX_KEPT are merged anew.
KEPT_COUNTS, MAX_KEPT = 200_000, 64


class _Counts(dict):
    """Token count of a pre-token: 1 for the proved ones, else merged and remembered."""

    def __init__(self, whole: frozenset[str], merge) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge = whole, merge

    def __missing__(self, pretoken: str) -> int:
        n = len(self.merge(pretoken))
        if len(pretoken) <= MAX_KEPT:
            if len(self) >= len(self.whole) + KEPT_COUNTS:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[pretoken] = n
        return n


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Add n_tokens and n_whole (pre-tokens counted by the shortcut), both long; no shuffle."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = vocab.share(spark, vocabulary)
    whole_set = spark.sparkContext.broadcast(vocab.load(vocabulary or vocab.default_path()).whole_tokens())

    @F.pandas_udf("struct<n_tokens:long,n_whole:long>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder, whole = vocab.coder_of(shared), whole_set.value
        counts = _Counts(whole, coder.merge)
        split, is_whole = coder.pretokens, whole.__contains__
        for texts in batches:
            rows = []
            for text in texts:
                n = k = 0
                for part, special in coder.parts(text or ""):
                    if special is None:
                        pretokens = split(part)
                        n += sum(map(counts.__getitem__, pretokens))
                        k += sum(map(is_whole, pretokens))
                    else:
                        n += 1
                rows.append((n, k))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_whole"])

    base = replace_columns(docs, ["n_tokens", "n_whole"])
    return (base.withColumn("__c", counted(F.col(text)))
            .select(*[F.col(f"`{c}`") for c in base.columns], "__c.n_tokens", "__c.n_whole"))
