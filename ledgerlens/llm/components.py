"""Connected components of a link table, by alternating star contractions.

Each round is two aggregations with a join on node ids. A hub's links are
pre-aggregated to a minimum in every task, and its rows may be split by the
join, so a node of any degree is fine. Nothing of the links reaches the
driver but whether they are settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's greater neighbours move to its least neighbour.
    Small star: each node's lesser neighbours and itself move to the least of them."""
    around = _both_ways(links)
    if not large:
        around = around.filter("b < a")
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = around.join(least, "a")
    if large:
        moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the links (from greater to lesser) are stars already: no node has
    two, and no centre is a leaf of another."""
    ends = links.select("a", F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
        links.select(F.col("b").alias("a"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    sums = ends.groupBy("a").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return not sums.filter("leaf > 1 OR (leaf > 0 AND centre > 0)").take(1)


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (columns a, b: longs); the root is
    the least node id of the component."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:  # every round that does not settle brings links closer to the least node
        links = stored(_star(stored(_star(links, True), "links-large"), False), "links-small")
        if _settled(links):
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
