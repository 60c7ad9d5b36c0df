"""Connected components by alternating large and small stars; DataFrame operations only, nothing on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node reachable) of every node that a link names.

    Links are undirected; loops, repeated links and nulls are harmless (a null end drops the link). Each round is an aggregate and a join
    on nodes, both of which Spark splits where a node has very many links; rounds grow with the logarithm of the components' sizes.
    """
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = cut(edges)
    loops = edges.where("u = v").select("u")
    edges, before = edges.where("u > v"), None
    while True:
        # large star: every larger neighbour of a node links to the smallest neighbour (or the node itself)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(edges.select("e.u", "e.v").where("u > v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = edges.select(F.col("v").alias("node")).union(loops.select(F.col("u").alias("node"))).distinct()
    own = own.join(edges.select(F.col("u").alias("node")), "node", "left_anti")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own.select("node", F.col("node").alias("root")))
