"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins; a hot centre is a skewed
join key, which adaptive execution splits, and every ``min`` is combined before
the shuffle.  The number of rounds grows with the logarithm of the largest
component, and no edge list ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.scratch import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join deals both sides itself and the edges of a hot node can be split
    low = materialize(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "low")
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    large = materialize(large, "large")
    small_low = materialize(large.groupBy("u").agg(F.min("v").alias("low")), "low")
    moved = large.join(small_low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(small_low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; the component is its smallest node.

    Null ends and loops are ignored.  Nodes must be of one orderable type.
    """
    now = materialize(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull())
        .filter("u > v")
        .distinct(),
        "edges",
    )
    mark = _signature(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        after = materialize(_round(now), "edges")
        discard(now)
        now, before = after, mark
        mark = _signature(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)
