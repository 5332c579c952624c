"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of edges (a, b): the component's smallest node.

    Each round points the neighbours of a node to the smallest among them, so chains shorten by a factor; rounds end when the edges stand still. Only
    minima are grouped; edges meet them in joins that Spark splits where a node has very many edges.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select("v", "v").distinct()).groupBy("node").agg(F.min("component").alias("component"))
        before = state
        # Large star: the larger neighbours of a node go to the smallest of node and neighbours.
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours of a node, and it, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        now = cut(small.select(F.col("x.u").alias("u"), F.col("x.v").alias("v")).where("u <> v").distinct())
