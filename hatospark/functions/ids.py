"""Surrogate keys: the highest key in use plus the row's place in request order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import total_before


def last_id(existing: DataFrame, key: str) -> Column:
    """The highest key in use, 0 for an empty table, as a scalar subquery."""
    return F.coalesce(existing.select(F.max(key)).scalar(), F.lit(0)).cast("bigint")


def assign_ids(df: DataFrame, seq: str, out: str, existing: DataFrame, key: str) -> DataFrame:
    """Number the rows of ``df`` by ``seq``, going on after the keys of ``existing``.

    The result depends on the data alone, so a recomputed task assigns the same keys.
    """
    placed = total_before(df, seq, F.lit(1), "_place")
    return placed.withColumn(out, last_id(existing, key) + F.col("_place") + 1).drop("_place")
