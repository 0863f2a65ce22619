"""Connected components of a link table, by alternating large-star and small-star steps.

Each step keeps every node linked to smaller ones only; with ``n`` nodes about ``log(n)`` rounds
end in stars around the smallest node of each component. Links are stored after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustledger.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node in a link; the component is its smallest node.

    The smallest neighbour of a node is a minimum, so a node with very many links costs no more
    than its share of rows: minima are combined before they are shuffled.
    """
    edges = scratch.store(links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low").distinct())
    previous = None
    while True:
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        smallest = scratch.store(both.groupBy(F.col("high").alias("node")).agg(F.least(F.min("low"), F.first("high")).alias("m")))
        # Large star: neighbours above the node go to its smallest neighbour.
        star = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).join(smallest, "node").select(F.col("other").alias("high"), F.col("m").alias("low"))
        star = scratch.store(star.distinct())
        # Small star: all links of a node below it go to the smallest of them.
        least = scratch.store(star.groupBy("high").agg(F.min("low").alias("m")))
        moved = star.join(least, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        edges = scratch.store(moved.unionByName(least.select("high", F.col("m").alias("low"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == previous:
            break
        previous = state
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
