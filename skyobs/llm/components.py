"""Connected components of a graph of links, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyobs.llm.runtime import checkpointed, compacted, spread_join


#: Edges up to which a node's edges may meet in one task.
HUB = 1_000_000


def _with_least(edges: DataFrame, least: DataFrame, spread: bool) -> DataFrame:
    """edges(u, w) with m, the least known for u. least has u, m and n, its number of edges; with spread, nodes with very many are spread."""
    if spread:
        return spread_join(edges, least, "u", "n", ["u", "w"]).filter("m is not null")
    return edges.join(least.select("u", "m"), "u")


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node that it reaches) for each node of links(a, b), two bigint columns.

    Large-star and small-star rounds hang every node under smaller neighbours until nothing changes; the
    rounds grow with the logarithm of the longest path. Minima by node are partial aggregates; with over HUB
    edges, what joins them deals a node with very many links to many tasks. Nodes without a link aren't
    returned; null ends and loops are ignored.
    """
    edges = checkpointed(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct())
    told = lambda: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
    before, now = None, told()
    edges = compacted(edges, now[0])
    while now != before:
        spread = now[0] > HUB
        kept = checkpointed if spread else lambda df: df
        both = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = kept(both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = _with_least(edges.select(F.col("w").alias("u"), F.col("u").alias("w")), least, spread).select(F.col("w").alias("u"), F.col("m").alias("w"))
        large = kept(large.filter("u != w").distinct())
        low = kept(large.groupBy("u").agg(F.min("w").alias("m"), F.count(F.lit(1)).alias("n")))
        small = _with_least(large, low, spread).select(F.greatest("w", "m").alias("u"), F.least("w", "m").alias("w")).filter("u != w").unionByName(low.select("u", F.col("m").alias("w")))
        edges = checkpointed(compacted(small.distinct(), now[0]))  # never more edges than before
        before, now = now, told()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("w").alias("root")).unionByName(edges.select(F.col("w").alias("node"), F.col("w").alias("root")).distinct())
