"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.session import Scratch


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum; tells whether a round changed anything."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _star(edges: DataFrame, scratch: Scratch, kept: Column, with_self: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them. ``edges`` has columns ``u, v``."""
    least = scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    # Both sides are plain scans, so that a node with very many neighbours can be split over tasks.
    linked = edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
    pairs = linked.filter(kept).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if with_self:
        pairs = pairs.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return scratch.table(pairs.filter("a <> b").distinct(), "edges")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: every node of an edge other than the root itself, with the smallest node it can reach.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014) until the edges are a star per component.
    Each step is written to ``scratch``. Rows with a null end and loops are ignored; repeated edges do not matter.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    pairs = pairs.filter("a <> b AND x IS NOT NULL AND y IS NOT NULL").select("a", "b").distinct()
    current = scratch.table(pairs, "edges")
    before = _digest(current)
    while before[0]:
        down = current.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = down.unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, scratch, F.col("v") > F.col("u"), with_self=False)
        small = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        current = _star(small, scratch, F.col("v") != F.col("m"), with_self=True)
        after = _digest(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
