"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipel.llm.common import drop_written, written


def _stars(edges: DataFrame) -> bool:
    """Whether every edge (a, b) leads from a node with no other edge to a centre."""
    n, nodes = edges.agg(F.count("*"), F.countDistinct("a")).first()
    return n == nodes and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def _to_least(pairs: DataFrame, keep_own: bool) -> DataFrame:
    """Of (u, v): every v, and u itself where asked for, linked to the least neighbour of u.

    The least neighbours are a table of their own, so the join has a shuffle on either side
    and adaptive execution can split a node that a large part of all edges meet.
    """
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = pairs.join(least, "u")
    out = joined.select(F.col("v").alias("x"), "m")
    if keep_own:
        out = out.unionByName(least.select(F.col("u").alias("x"), "m"))
    return out.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of `edges` (a, b); a component is named by its least node.

    Alternates large-star and small-star steps until the edges form stars, which takes a
    number of rounds logarithmic in the size of the largest component; it goes on until they
    do. Edges stay in tables throughout; the driver sees two counts a round.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        with_self = both.unionByName(both.select("u", F.col("u").alias("v")).distinct())
        large = written(_to_least(with_self, False), "edges")
        small = written(_to_least(large.select(F.col("a").alias("u"), F.col("b").alias("v")), True), "edges")
        drop_written(now, large)
        now = small
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
