"""Connected components by alternating stars, on edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.sources.scratch import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v: links neighbours to the least of them and u.

    Large: the greater neighbours of each vertex. Small: its lesser neighbours and itself.
    """
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # Written out, so that both sides of the join are plain shuffles: Spark splits the edges of a vertex that has very many.
    least = staged(seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    linked = seen.join(least, "u")
    new = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where("u > v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (u, v); the root is the least node of its component.

    Each round is written out, so a lost executor repeats one round at most. Rounds grow with the logarithm of the longest
    path. Ends when a round leaves the edges as they were.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges, before = staged(edges, name), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, edges = now, staged(_star(_star(edges, True), False), name)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
