"""Connected components of an edge table, by alternating large and small stars.

Every step is a join or an aggregation with map-side combining; a hub's edges may be split among
tasks, because both inputs of each join are written tables. Nothing is collected. A round's tables have as
many tasks as the edges are worth, so that small tables don't pay for many shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node with an edge, the smallest node that it reaches. Null ends and loops count for nothing."""
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct())
    seen = _state(now)
    while True:
        rows = 2 * seen[0]
        both = now.union(now.select("y", "x"))
        least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m")), rows=rows)
        large = cut(both.join(least, F.col("x") == F.col("k")).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), rows=rows)
        discard(now, least)
        least = cut(large.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), "m"), rows=rows)
        small = large.join(least, F.col("x") == F.col("k")).where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = cut(small.union(least).distinct(), rows=rows)
        discard(large, least)
        state = _state(now)
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("y").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = cut(now.select(F.col("x").alias("node"), F.col("y").alias("component")).union(roots), rows=2 * seen[0])
    discard(now)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
