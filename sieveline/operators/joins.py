"""Joins with a small side whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.sources.scratch import written

# Broadcast a side only below both bounds; otherwise shuffle (AQE splits
# skewed partitions of the large side).
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def measure(small: DataFrame, text_cols: list[str] | None = None) -> tuple[int, int]:
    """(rows, approximate bytes) of a small table in one aggregate."""
    cols = text_cols if text_cols is not None else [f.name for f in small.schema.fields
                                                   if f.dataType.simpleString() == "string"]
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in cols), F.lit(0)) + F.lit(16 * len(small.columns))
    row = small.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS,
               max_bytes: int = MAX_BROADCAST_BYTES, keep: bool = True) -> DataFrame:
    """Join ``big`` with ``small``; ``small`` is measured first (one small
    job) and broadcast only when it is under both bounds -- else a plain
    shuffle join. It is read twice, so it is written to the shared folder
    once unless ``keep`` is off (cheap to make again)."""
    if keep:
        small = written(small, "small-side")
    rows, size = measure(small)
    if rows <= max_rows and size <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
