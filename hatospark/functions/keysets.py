"""Exact sets of integer keys as bitmaps: one bit per key, in buckets of 32,768 consecutive keys.

Keys that are assigned without gaps (``functions/ids.py``) take a bit each, so the set of a table with a
billion keys is 120 MB in rows of 4 KB, and values are looked up bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, BITS = "_cubo", "_bits"


def key_bitmaps(keys: DataFrame, by: list[str], key: str) -> DataFrame:
    """One row per ``by`` and bucket that holds a key; built map-side, so no key is shuffled on its own."""
    bucket = F.bitmap_bucket_number(F.col(key)).alias(BUCKET)
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias(BITS)
    return keys.filter(F.col(key).isNotNull()).groupBy(*by, bucket).agg(bits)


def holds(bits: Column, key: Column) -> Column:
    """Whether the bitmap of the key's bucket has the key's bit; false for no bitmap."""
    position = F.bitmap_bit_position(key)
    byte = F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    # Shifted by a column, so as a power of two.
    return F.coalesce(F.floor(number / F.pow(F.lit(2), position % 8)) % 2 == 1, F.lit(False))


def not_in(rows: DataFrame, keys: DataFrame, by: list[str], key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in no row of ``keys`` with the same ``by``."""
    held = rows.withColumn(BUCKET, F.bitmap_bucket_number(F.col(key)))
    held = held.join(key_bitmaps(keys, by, key), [*by, BUCKET], "left")
    return held.filter(~holds(F.col(BITS), F.col(key))).select(rows.columns)
