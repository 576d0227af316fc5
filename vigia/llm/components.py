"""Connected components of a link table by alternating large and small stars.

Every round is a few aggregations and joins on node ids; nothing is gathered per component, so one
component may hold any share of the nodes. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none: one aggregate."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()


def stars(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (u, v) that are not their component's smallest node."""
    now = stage(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _are_stars(now):
        now = stage(_small_star(_large_star(now)), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is its smallest node."""
    own = stars(links)
    return own.unionByName(own.select(F.col("component").alias("node"), "component").distinct())
