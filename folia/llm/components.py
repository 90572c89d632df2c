"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.sources.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``, longs; the component is its least node.

    Each step is written to the shared folder, so a lost executor costs one step and the plan stays short.
    Both kinds of step move rows by node; the adaptive skew join splits the hub of a large component.
    No links give no rows; loops and repeated links change nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "edges")
    before = _state(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
