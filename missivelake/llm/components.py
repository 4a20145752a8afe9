"""Connected components of an edge table by alternating minimum-label steps, each stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missivelake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node.

    Large-star links every neighbour larger than a node to the smallest of its neighbourhood, small-star links a node
    and its smaller neighbours to the smallest of them; repeated until nothing changes, every tree is a star. A star's
    centre gets its rows by aggregation and an equi-join only, and edges never grow in number.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    both = stored(both, "components")
    before = None
    while True:
        # large-star
        sides = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star
        large = stored(large, "components")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        both = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "components")
        now = both.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if now == before:
            break
        before = now
    return both.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(both.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
