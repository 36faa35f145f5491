"""Connected components as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): its component's smallest node.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each a minimum by node, which is partly
    summed before the shuffle, and a join of the edges with it, which Spark splits where a node has very many.
    Two numbers a round reach the driver; each round's edges are checkpointed.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint()
    state = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = small.filter("u <> v").distinct().checkpoint()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
