"""Connected components of a graph of any size: alternating large-star and small-star rounds, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for every node of edges (a long, b long); isolated nodes do not appear.

    A node with many edges is met by partial minima and joins whose skewed side can be split.
    """
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tops = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(tops, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tops.select("u", F.col("m").alias("v")))
        cur = written(small.distinct(), "edges")
        new = _state(cur)
        if new == state:
            break
        state = new
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
