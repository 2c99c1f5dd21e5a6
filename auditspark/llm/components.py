"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round replaces edges by edges to the smallest neighbour; no neighbourhood is gathered, only its minimum is
computed (with map-side partial minima) and joined back, so a hub is no hot task. Rounds are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(v, component): every node with an edge to another, and the smallest node it reaches. edges: (u, v) as longs."""
    spark = edges.sparkSession
    larger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    cur = cut(edges.where("u <> v").select(larger, smaller).distinct())
    before = None
    while (now := _state(cur)) != before:
        before = now
        if not now[0]:
            break
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        release(spark)
    return cur.groupBy(F.col("u").alias("v0")).agg(F.min("v").alias("component")).select(F.col("v0").alias("v"), "component").unionByName(
        cur.select(F.col("v")).distinct().join(cur.select(F.col("u").alias("v")), "v", "left_anti").select("v", F.col("v").alias("component"))
    )
