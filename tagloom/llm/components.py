"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(scratch: Scratch, pairs: DataFrame, small: bool) -> DataFrame:
    """One star operation on rows (u, v); hub nodes are split by the skew join because both sides are stored tables."""
    low = scratch.put(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
    joined = pairs.join(low, "u")
    if small:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.where("u <> m").select("u", "m"))
    else:
        out = joined.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = scratch.put(out.distinct(), "star")
    scratch.drop(low)
    return out


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge list of longs; the component is its smallest node.

    Self-loops and repeated or reversed edges are harmless; nodes without an
    edge to another node do not appear. An empty list gives an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = scratch.put(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = _star(scratch, both, small=False)
        scratch.drop(now)
        now = _star(scratch, large.select(F.col("a").alias("u"), F.col("b").alias("v")), small=True)
        scratch.drop(large)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
