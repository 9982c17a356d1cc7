"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and pre-aggregated groupings, checkpointed; no link or component reaches the driver, and a star
with any number of leaves is spread by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return _clean(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger end to the smaller one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _clean(linked.union(least.select("u", F.col("m").alias("v"))))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for each node with an edge to another one; ``root`` is the smallest node it reaches.

    Nulls: an edge with a null end is no edge. Repeated edges and loops don't matter. No edges: no rows.
    """
    current = cut(_clean(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    mark = _mark(current)
    while mark[0]:
        current = cut(_small_star(_large_star(current)))
        now = _mark(current)
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
