"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from lexiloom.llm.storage import settled


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of a link; empty links give an empty result.

    A hub's links are pre-aggregated before they are shuffled, and no group of neighbours is gathered. Each round is
    checkpointed; their number grows with the logarithm of the longest path.
    """
    e = settled(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    last = None
    while True:
        # large star: the greater neighbours of u are linked to the least of u and its neighbours
        near = _both(e)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its lesser neighbours are linked to the least of these
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        e = settled(small.select("hi", F.col("m").alias("lo")).unionByName(small.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        last = now
