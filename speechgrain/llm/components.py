"""Connected components of a large edge list by alternating large-star and small-star steps.

Each step is a ``groupBy().min()`` (combined before the shuffle) and a join back, so a hub with many edges is an ordinary
skewed join key. From ``SPLIT`` edges on, the minima are written before the join: Spark can split a skewed key only between two
plain shuffles. The number of rounds is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


SPLIT = 1_000_000


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame, split: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = checkpointed(least) if split else least
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, split: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    least = checkpointed(least) if split else least
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(rest).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``, the component named by its smallest node.

    Only nodes with an edge to another node are returned. Nulls and self-loops are ignored; no edges give no rows.
    """
    now = checkpointed(_oriented(edges.where("a is not null and b is not null")))
    sign = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    before = sign(now)
    if before[0]:
        split = before[0] >= SPLIT
        for _ in range(max_rounds):
            now = checkpointed(_small_star(checkpointed(_large_star(now, split)) if split else _large_star(now, False), split))
            after = sign(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
