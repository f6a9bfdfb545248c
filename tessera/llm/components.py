"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two joins that adaptive
execution may split, so a hub with many neighbours does not land in one task; links and
labels stay distributed, and only two numbers a round reach the driver.  Each round is
written to the shared scratch folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v) with u > v.  Link the neighbours of each node to the least of them."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # the neighbours above a node link to the least neighbour
        out = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node with a link, the least node it reaches."""
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, was = common.materialize(now, "links"), None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == was or not seen[0]:
            break
        was = seen
        before, now = now, common.materialize(_star(_star(now, True), False), "links")
        common.release(before)
    else:
        raise RuntimeError("components: no fixed point was reached")
    # at the fixed point every link goes from a node to the root of its star
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
