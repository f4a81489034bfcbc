"""Connected components of an edge table by alternating large and small stars; no neighbour list is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import removed, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (large) or smaller neighbours, and the node itself in the latter case, go to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")).select("_u", F.least("m", "_u").alias("m"))
    near = both.join(least, F.col("u") == F.col("_u"))
    if large:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """edges: u, v. Returns node, component (smallest node reachable) for each node that has an edge to another one.

    Every round is written to the shared folder; it ends when a round changes nothing.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{folder}/edges-0")
    seen, spark = None, edges.sparkSession
    for i in range(1, most_rounds + 1):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        after = stored(_star(_star(now, True), False), f"{folder}/edges-{i}")
        removed(spark, f"{folder}/edges-{i - 1}")
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
