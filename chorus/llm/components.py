"""Connected components of an undirected edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.shared import stored


def all_stars(edges: DataFrame) -> bool:
    """Whether every component of ``edges`` (u, v), u > v, distinct, is a star around its smallest node:
    no node with a smaller neighbour has a second edge. One aggregate with partial sums."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("low")), F.struct(F.col("v").alias("node"), F.lit(0).alias("low"))))
    seen = edges.select(ends.alias("e")).groupBy("e.node").agg(F.max("e.low").alias("low"), F.count(F.lit(1)).alias("n"))
    return seen.where("low = 1 and n > 1").limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable over ``edges``.

    Alternates two contractions until all components are stars: every node hands its larger neighbours
    to its smallest neighbour, then every node hands its smaller neighbours to the smallest of them. Each
    round is one aggregate and one join over the edges, stored in the shared folder; the number of
    rounds grows with the logarithm of the longest chain. Nodes without an edge do not appear; an
    empty table gives none. No node's neighbours are ever collected: minima are aggregated."""
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not all_stars(now):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                                 F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        now = stored(small, "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
