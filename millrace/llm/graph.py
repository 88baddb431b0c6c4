"""Connected components of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _state(edges: DataFrame) -> tuple:
    # order-free: number of edges and the exclusive or of their hashes
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) to (node, root): every linked node with the smallest node that it reaches.

    Alternates the large-star and small-star steps: first every node hands its larger neighbours to its smallest
    one, then its smaller ones, until nothing changes; the number of rounds grows with the logarithm of the
    longest path. Minima combine before the shuffle, so a node with many neighbours is no hot key there, and the
    joins with one row per node can be split by AQE. Every round is written, which cuts the lineage.
    Links from a node to itself are dropped.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = materialize(links.filter(F.col(a) != F.col(b)).select(u, v).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
