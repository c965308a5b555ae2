"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed, looked_up


def components(links: DataFrame, rounds: int = 60, hot: int | None = None) -> DataFrame:
    """(node, component) for every node of links(a, b); component is the smallest node reachable.

    Each step takes the minimum of a node's neighbours with a combinable aggregate and looks it up for each link. The
    links of a hub are never gathered in one task: nodes of very many links are looked up in a broadcast table of bounded
    size (`looked_up`; hot: from how many links). Every round is checkpointed; the number of rounds
    grows with the logarithm of the longest chain. Self-links and links with a null end are dropped.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpointed(edges)
    for _ in range(rounds):
        twice = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(twice.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
        large = looked_up(twice, least, "u", "m", hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = looked_up(large, least, "u", "m", hot).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        split = edges.groupBy("u").count().where("count > 1").select("u")
        chained = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if split.unionByName(chained).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
