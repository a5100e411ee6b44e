"""Snapshots laid out by key range, of which a batch rewrites only the ranges it touches.

A snapshot is a Parquet folder partitioned by ``tramo``, the key divided by a width.  An update reads
the partitions that the keys of the batch fall into, and Spark's dynamic partition overwrite
replaces just these: files of other ranges are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a range, and the column that names it.
WIDTH, RANGE = 1 << 20, "tramo"


def range_of(key: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(key) / F.lit(width)).cast("bigint")


def _write(rows: DataFrame, key: str, folder: str, width: int) -> None:
    # One writer a range: a range is bounded, so is its writer. No key is null.
    rows = rows.withColumn(RANGE, range_of(key, width)).repartition(RANGE)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(folder)


def write_snapshot(rows: DataFrame, key: str, folder: str, width: int = WIDTH) -> None:
    """Write all rows under a new ``folder``; ``key`` is a number and never null."""
    _write(rows, key, folder, width)


def read_snapshot(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """The snapshot's rows, with the columns of ``rows``."""
    schema = rows.select("*", F.lit(0).cast("bigint").alias(RANGE)).schema
    return spark.read.schema(schema).parquet(folder).select(rows.columns)


def touched(batch: DataFrame, key: str, width: int = WIDTH) -> list[int]:
    """The ranges that the batch's keys fall into: at most one number per partition of the snapshot."""
    ranges = batch.filter(F.col(key).isNotNull()).select(range_of(key, width).alias(RANGE)).distinct()
    return sorted(r[0] for r in ranges.collect())


def update_snapshot(
    folder: str,
    batch: DataFrame,
    key: str,
    change: Callable[[DataFrame], DataFrame],
    like: DataFrame,
    width: int = WIDTH,
) -> list[int]:
    """Replace the ranges that ``batch`` touches by ``change`` of their rows; returns the ranges.

    ``change`` gets the rows of all touched ranges (columns as ``like``) and returns them, with
    changed, new or fewer rows of the same ranges. The replaced files stay until the new ones are complete, so a
    job that fails before that leaves the snapshot as it was. Moving the new files in is not one step over all
    ranges; ``change`` should give the same rows when a batch is applied again.
    """
    ranges = touched(batch, key, width)
    if ranges:
        spark = batch.sparkSession
        schema = like.select("*", F.lit(0).cast("bigint").alias(RANGE)).schema
        rows = spark.read.schema(schema).parquet(folder).filter(F.col(RANGE).isin(ranges))
        _write(change(rows.select(like.columns)), key, folder, width)
    return ranges
