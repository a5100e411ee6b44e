"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("n")).filter("b > a").selectExpr("b AS a", "m AS b")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    rest = down.join(least, F.col("a") == F.col("n")).filter("b > m").selectExpr("b AS a", "m AS b")
    return rest.union(least.selectExpr("n AS a", "m AS b"))


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots, the least nodes of components.

    Each round is a few grouped minima and joins, and is written to the shared folder, so that a
    lost executor costs one round. Neither links nor nodes come to the driver, only a count and a
    checksum. Rounds grow with the logarithm of the longest chain. Nulls are no nodes.
    """
    links = checkpoint(links.select("a", "b").filter("a <> b").distinct())
    before, state = None, _state(links)
    while state != before and state[0]:
        links = checkpoint(_small_star(_large_star(links)).filter("a <> b").distinct())
        before, state = state, _state(links)
    return links.selectExpr("a AS node", "b AS root")
