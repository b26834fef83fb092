"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b); the root is the least id that can be reached.

    In a large-star round each id links its greater neighbours to the least one, in a small-star round its
    smaller neighbours and itself; both only need the least neighbour, so a hub of any degree is an
    ordinary aggregate and its join is split where it is skewed. The number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder."""
    now = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        step += 1
        now = ws.save(small.where("u <> v").distinct(), f"{name}-{step}")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        # stars: every id has one edge, and roots have none
        if not seen["n"] or (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
