"""Connected components over a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemill.llm.shared import discard, keep


def _print(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of `links` (a, b): component is the
    smallest node that links reach.

    Large-star and small-star steps alternate until nothing changes, a number
    of rounds that grows with the logarithm of the longest path. Each step is a
    minimum per node (pre-aggregated before its shuffle, and written) joined to
    the links by a merge that Spark can split, so no node's neighbours meet in
    one group. Rows with nulls and self-links say nothing and are left out; no
    rows give no rows.
    """
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _print(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large.distinct())
        root = large.groupBy("a").agg(F.min("b").alias("m"))  # a node has few stars by now
        small = large.join(root, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, keep(small.union(root.select("a", F.col("m").alias("b"))).distinct())
        for done in (last, least, large):
            discard(done)
        now = _print(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
