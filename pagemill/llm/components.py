"""Connected components by alternating large-star and small-star steps.

Each step is a partially aggregated minimum per node and one join, so a hub's links are never gathered
in one place; the links of every round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, staged


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, root): every node of a link with the least node it can reach.

    Loops and repeated links change nothing; no links give no rows.  Every round brings the links nearer to
    stars, so the loop ends by itself, after about the logarithm of the longest path in rounds.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = staged(pairs, "links")
    while not settled(pairs):
        wide = staged(large_star(pairs), "wide")  # written, since the next step reads it three times
        before, pairs = pairs, staged(small_star(wide), "links")
        forget(before)
        forget(wide)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b")).distinct()


def settled(pairs: DataFrame) -> bool:
    """Whether every node above a root has that one link only, and no root has one."""
    twice = pairs.groupBy("a").count().where("count > 1").limit(1)
    above = pairs.join(pairs.select(F.col("a").alias("u")), F.col("b") == F.col("u"), "left_semi").limit(1)
    return not twice.count() and not above.count()


def large_star(pairs: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node of the neighbourhood."""
    both = pairs.union(pairs.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    # pairs are (higher, lower): the neighbours above u are the a of pairs whose b is u
    return pairs.join(least, pairs["b"] == least["u"]).select("a", F.col("m").alias("b")).distinct()


def small_star(pairs: DataFrame) -> DataFrame:
    """Every node and its neighbours below it are linked to the least of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = pairs.join(least, pairs["a"] == least["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
