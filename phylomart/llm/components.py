"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylomart.runtime import cut_lineage


def _step(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over undirected edges (a, b), a < b.

    Large step: every node ties its larger neighbours to the smallest node near it. Small step: every node ties
    itself and its smaller neighbours to the smallest. Both keep components. The smallest is an aggregate per node,
    written before it is joined back, so that a node with very many edges can be split.
    """
    if larger:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(near.groupBy("a").agg(F.least("a", F.min("b")).alias("low")))
        moved = near.join(least, "a").where("b > a").select(F.col("low").alias("a"), "b")
    else:
        # (a, b): a is a smaller neighbour of b
        least = cut_lineage(edges.groupBy("b").agg(F.min("a").alias("low")))
        tied = edges.join(least, "b")
        moved = tied.select(F.col("low").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("low").alias("a"), "b"))
    return cut_lineage(moved.where("a < b").distinct())


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component, and has no row.

    Alternates large and small star steps until a pass changes nothing; then every edge leads to its root. The number of passes
    grows with the logarithm of the longest chain, and no component is gathered in one place.
    """
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    told = None
    while True:
        # count and an order-free digest of the edges
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == told:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        told = now
        edges = _step(_step(edges, True), False)
