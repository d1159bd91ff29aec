"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the node; a hub's links are reduced before the shuffle and its join is
split by adaptive execution. The number of steps grows with the logarithm of a component's width. Nothing but a count
and a checksum of the links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b), a > b: large hangs greater neighbours, small hangs lesser ones, on the least."""
    if large:
        around = links.union(links.select("b", "a")).toDF("u", "v")
    else:
        around = links.toDF("u", "v")
    least = around.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, F.col("u") == F.col("w"))
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("w", "m"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def _mark(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Rows (node, root): for every node of a link the smallest node reachable. Null ends and loops are left out.

    An empty table of links gives no rows; repeated links count once.
    """
    a, b = F.col(left), F.col(right)
    now = links.where(a.isNotNull() & b.isNotNull() & (a != b))
    now = cut_lineage(now.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = _mark(now)
    while before[0]:
        now = cut_lineage(_star(_star(now, True), False))
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    # now every link leads from a node to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
