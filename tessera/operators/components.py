"""Connected components of a graph held as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.durable import cut


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, _m): the least v of each u. Grouped by struct(u), so that a join on u deals both sides out anew and a hub's rows can be split."""
    return pairs.groupBy(F.struct("u").alias("_k")).agg(F.min("v").alias("_m")).select(F.col("_k.u").alias("u"), "_m")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one smaller end, and no node is both."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)))
    return not bad.first()[0]


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 64) -> DataFrame:
    """(node, component) for every node with an edge to another one; component is the least node that it reaches.

    In a large star each node links its larger neighbours to its least one, in a small star its smaller neighbours and
    itself; the rounds end once the edges are stars around the least node of each component (a number of rounds that
    grows with the logarithm of the size). Minima are combined before the exchange and every join is between two plain
    exchanges, so that the many rows of a hub are split. Each round is written to the checkpoint folder. Edges with a
    null end and loops are left out; an empty table gives no rows.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    for _ in range(most_rounds):
        if _are_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).withColumn("_m", F.least("u", "_m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        least = _least_neighbour(large)
        small = large.join(least, "u").filter(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        now = cut(small.union(least.select("u", F.col("_m").alias("v"))).distinct())
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
