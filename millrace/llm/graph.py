"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """id, component: for each id in links (a, b), the smallest id it reaches.

    Each round hangs a node's larger neighbours, then its smaller ones, below the smallest neighbour; the links become
    stars within a number of rounds about the logarithm of the longest path. Only minima are gathered for a node, and
    only a count and a checksum come to the driver. Null ids and links of a node with itself are left out.
    """
    e, seen = checkpoint(links.select("a", "b").where("a <> b").distinct()), None
    while True:  # about the logarithm of the longest path, squared at worst
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        hung = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        e = checkpoint(hung.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
