"""Connected components of an edge table by alternating large and small stars; every step is a join and a sum."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the least of them; large: those above the node, else those below it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        linked = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of all nodes with an edge; the component is the least node. edges: u, v long, u != v. Rounds go
    on until none changes an edge; there are about as many as the logarithm of the longest path, squared at most."""
    now = scratch.keep(edges.select("u", "v").distinct(), f"{name}0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    for i in count(1):
        now = scratch.keep(stars(stars(now, True), False), f"{name}{i}")
        scratch.free(f"{name}{i - 1}")
        after = mark(now)
        if after == before:
            break
        before = after
    own = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(own.select(F.col("component").alias("node"), "component").distinct())
