"""Connected components of a distributed edge table (union-find by stars).

Large-star and small-star steps alternate: each node hands the neighbours
above it (large) or up to it (small) to the smallest of them, until every
component is a star around its smallest node. Edges stay in tables of the
shared folder; only whether they are stars yet reaches the driver. Minima are
pre-aggregated before the shuffle and the joins on a hot node are split by
adaptive execution, so no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import remove_written, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a")).toDF("u", "v")


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def _is_stars(edges: DataFrame) -> bool:
    """Every upper node has one edge, and no lower node is an upper one."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    counts = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return counts.where("ups > 1 OR ups = 1 AND least = 0").isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): each node but the smallest of its component with that smallest node; a written table.

    ``edges`` has two long columns; edges from a node to itself say nothing.
    """
    flat = edges.toDF("a", "b").where("a <> b")
    now = written(flat.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_stars(now):
        after = written(_small_star(_large_star(now)).where("a <> b").distinct(), "edges")
        remove_written(now)
        now = after
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node of the component."""
    star = stars(edges)
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
