"""Ordered computations that never gather one key into one task.

Rows of a key are cut into blocks of ``2**bits`` consecutive sequence numbers.
The sequence is a unique integer per key, so a window over (key, block) holds
at most ``2**bits`` rows however hot the key is.  What crosses block borders is
carried by a second, tiny table with one row per (key, block), which a map-side
aggregation builds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS, BLOCKS_BITS = 20, 21
_BLOCKS, _FAR = "_blocks", "_far"
_BLOCK, _VALUE, _MARK, _WITHIN, _CARRY = "_block", "_value", "_mark", "_within", "_carry"


def _neighbour(df, keys, seq, value, out, bits, forward):
    order = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    pick = F.min_by if forward else F.max_by
    rows = df.withColumns({_BLOCK: F.shiftright(F.col(seq), bits), _VALUE: value})
    before = (Window.unboundedPreceding, -1)
    marks = rows.groupBy(*keys, _BLOCK).agg(
        pick(_VALUE, F.when(F.col(_VALUE).isNotNull(), F.col(seq))).alias(_MARK)
    )
    carry = marks.select(
        *keys,
        _BLOCK,
        F.last(_MARK, ignorenulls=True)
        .over(Window.partitionBy(*keys).orderBy(order(_BLOCK)).rowsBetween(*before))
        .alias(_CARRY),
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order(seq)).rowsBetween(*before)
    rows = rows.withColumn(_WITHIN, F.last(_VALUE, ignorenulls=True).over(inside))
    return (
        rows.join(carry, [*keys, _BLOCK], "left")
        .withColumn(out, F.coalesce(_WITHIN, _CARRY))
        .drop(_BLOCK, _VALUE, _WITHIN, _CARRY)
    )


def next_value(
    df: DataFrame, keys: list[str], seq: str, value: Column, out: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Add ``out``: the nearest non-null ``value`` on a later row of the same key."""
    return _neighbour(df, keys, seq, value, out, bits, forward=True)


def previous_value(
    df: DataFrame, keys: list[str], seq: str, value: Column, out: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Add ``out``: the nearest non-null ``value`` on an earlier row of the same key."""
    return _neighbour(df, keys, seq, value, out, bits, forward=False)


def total_before(
    df: DataFrame, seq: str, value: Column, out: str, keys: tuple = (), bits: int = BLOCK_BITS
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows (of the same key).

    Sequence numbers may lie as far apart as 64 bits allow: blocks are summed in blocks in
    turn, so no window holds more rows than there are numbers in a block of either kind.
    """
    rows = df.withColumns({_BLOCK: F.shiftright(F.col(seq), bits), _VALUE: value})
    before = (Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, _BLOCK).agg(F.sum(_VALUE).alias(_MARK))
    sums = sums.withColumn(_BLOCKS, F.shiftright(_BLOCK, BLOCKS_BITS))
    far = sums.groupBy(*keys, _BLOCKS).agg(F.sum(_MARK).alias(_MARK)).select(
        *keys,
        _BLOCKS,
        F.sum(_MARK)
        .over(Window.partitionBy(*keys).orderBy(_BLOCKS).rowsBetween(*before))
        .alias(_FAR),
    )
    near = Window.partitionBy(*keys, _BLOCKS).orderBy(_BLOCK).rowsBetween(*before)
    sums = sums.withColumn(_CARRY, F.sum(_MARK).over(near))
    none = F.lit(0)
    carry = sums.join(far, [*keys, _BLOCKS], "left").select(
        *keys, _BLOCK, (F.coalesce(_CARRY, none) + F.coalesce(_FAR, none)).alias(_CARRY)
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(seq).rowsBetween(*before)
    rows = rows.withColumn(_WITHIN, F.sum(_VALUE).over(inside))
    zero = F.lit(0)
    return (
        rows.join(carry, [*keys, _BLOCK], "left")
        .withColumn(out, F.coalesce(_WITHIN, zero) + F.coalesce(_CARRY, zero))
        .drop(_BLOCK, _VALUE, _WITHIN, _CARRY)
    )
