"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Ties nodes to the least node in reach; pairs (u, v) with u > v."""
    if larger:
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        tied = pairs.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
    return tied.distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node reachable) for every node that has a link to another.

    links: two long columns.  Minima are pre-aggregated, so a node with very many
    links is no more than a skewed join, which the optimiser splits.
    """
    pairs = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
        if state[0] == 0 or tuple(state) == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(state)
        pairs = cut(_star(_star(pairs, True), False))
