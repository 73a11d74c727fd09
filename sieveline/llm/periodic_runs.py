"""Periodic runs of words: found in whole texts and collapsed to one period.

A run is a stretch of consecutive words with smallest period p (words p apart
are the same), of at least ``least`` words and two periods, that no
neighbouring word extends. All runs of a text are found, nested and
overlapping ones too, by string synchronising sets at dyadic scales
(``syncsets``). In a task the words of a whole Arrow batch are one sequence,
with an item between texts that occurs once; texts are ordered by length, so
that larger scales look only at texts long enough for them. A text stays in
one task and needs some 60 bytes per word there; nothing is shuffled.

Collapsing drops a word if any run has it after its first period.

Defined results: null or empty text, or text without words, has no runs and
collapses to empty text; repeated rows and ties each have their own row with
equal results; null ids keep their rows; an empty table gives no rows; input
columns that clash with an output name are replaced.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sieveline.llm.common import bound_batches, replace_columns

#: Words of the shortest run.
LEAST = 12
_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
OUT = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
       T.StructField("collapsed", T.StringType())]


def runs_of(texts: list[list], least: int = LEAST):
    """Runs of each list of words as arrays of (start, end, period)."""
    import numpy as np

    from sieveline.llm.syncsets import maximal_runs
    order = sorted(range(len(texts)), key=lambda d: -len(texts[d]))
    number = defaultdict(itertools.count().__next__)
    sizes = np.array([len(texts[d]) for d in order], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    items = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    for k, d in enumerate(order):
        a = ends[k] - 1 - sizes[k]
        items[a:ends[k] - 1] = np.fromiter(map(number.__getitem__, texts[d]), dtype=np.int64, count=sizes[k])
        items[ends[k] - 1] = -1 - k
    def reach(n):
        k = int((sizes >= n).sum())
        return int(ends[k - 1]) if k else 0
    runs = maximal_runs(items, reach, least)
    of = np.searchsorted(ends, runs[:, 0], side="right")
    runs[:, :2] -= (ends - 1 - sizes)[of, None] if len(ends) else 0
    cuts = np.searchsorted(of, np.arange(len(order) + 1))
    out = [None] * len(texts)
    for k, d in enumerate(order):
        out[d] = runs[cuts[k]:cuts[k + 1]]
    return out


def collapse(words: list[bytes], runs) -> bytes:
    """The words without those after the first period of a run, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    import numpy as np
    n = len(words) + 1
    covered = np.cumsum(np.bincount(runs[:, 0] + runs[:, 2], minlength=n) - np.bincount(runs[:, 1], minlength=n))
    return b" ".join(itertools.compress(words, covered[:-1] == 0))


def mark_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The documents with n_words, runs (by start and period) and the collapsed text."""
    bound_batches(docs.sparkSession)
    base = replace_columns(docs, [f.name for f in OUT])
    run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def mark(batches):
        import numpy as np
        for batch in batches:
            texts = [(x or b"").split() for x in batch.column(text).cast(pa.binary()).to_pylist()]
            found = runs_of(texts, least)
            flat = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
            sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
            rows = pa.StructArray.from_arrays(
                [pa.array(x) for x in (flat[:, 0], flat[:, 1] - flat[:, 0], flat[:, 2])], fields=list(run_type))
            collapsed = pa.array([collapse(w, r) for w, r in zip(texts, found, strict=True)], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(w) for w in texts], type=pa.int64()),
                 pa.ListArray.from_arrays(pa.array(sizes), rows), collapsed.cast(pa.string())],
                names=[*batch.schema.names, *[f.name for f in OUT]])

    return base.mapInArrow(mark, T.StructType([*base.schema.fields, *OUT]))
