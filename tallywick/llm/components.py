"""Connected components of an edge table, by alternating stars.

Each round is two joins of the edges with their per-node minimum; edges become
stars around the least node of each component in a number of rounds that grows
with the logarithm of the largest component.  Every round is cut by a reliable
checkpoint.  Only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """pairs (u, v): every v goes to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = pairs.join(least, "u")
    if keep_larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) of every node with an edge that isn't itself its root, the
    least node of its component.  Edges are the first two columns, as longs."""
    a, b = edges.columns[:2]
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)
        now = cut(_star(large, False))
    raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
