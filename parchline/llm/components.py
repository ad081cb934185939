"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``, the root being the least node of its component.

    Each round links every node to the least of its neighbours, first among its larger and then among its smaller ones,
    until the edges are stars. A round is two aggregates (combined before the shuffle) and two joins; no
    node's neighbours are gathered. Rounds are written to the shared folder; only a count and a checksum
    come to the driver.
    """
    forward = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current, before = written(forward, "edges"), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join shuffles both sides and a node with many neighbours can be split.
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v").distinct())
