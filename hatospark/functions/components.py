"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import checkpoint


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the least node around it."""
    both = links.union(links.selectExpr("b AS a", "a AS b"))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    around = both.join(least, F.col("a") == F.col("n")).filter("b > a")
    return around.select(F.col("b").alias("a"), F.least("n", "m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    between = down.join(least, F.col("a") == F.col("n")).filter("b > m").selectExpr("b AS a", "m AS b")
    return between.union(least.selectExpr("n AS a", "m AS b"))


def least_of_component(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (a, b): ``root`` is the least node that links lead to.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    links = links.select("a", "b")
    alone = links.filter("a = b").select("a")
    links, before = checkpoint(links.filter("a <> b").distinct()), None
    while True:
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before or not state[0]:
            break
        before = state
        links = checkpoint(_small_star(_large_star(links)).filter("a <> b").distinct())
    found = links.selectExpr("a AS node", "b AS root")
    ends = found.select("root").union(alone).distinct().selectExpr("root AS node", "root")
    # A node alone in one link can have neighbours in another one.
    return found.union(ends.join(found.select("node"), "node", "left_anti"))
