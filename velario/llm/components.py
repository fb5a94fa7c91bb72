"""Connected components of a link table, distributed: alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle, so a hub costs one row a task) and a
join back; the links are rewritten to a shared table, and none of them reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.common import Scratch


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = _least(both).withColumn("m", F.least("c", "m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """links lead from the larger node to the smaller one, as _large_star makes them."""
    least = _least(links)
    moved = links.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node leads to one node only, which leads nowhere."""
    ends = links.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)").isEmpty()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: (u, v); null ends are no links. Returns (node, component) of every linked node but the components' smallest."""
    state = scratch.table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(state):
        old = state
        state = scratch.table(_small_star(_large_star(state)))
        scratch.drop(old)
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
