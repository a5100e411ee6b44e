"""Joins for shapes the adaptive skew join cannot split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_ROWS = 1_000_000


def left_join_many(
    left: DataFrame, right: DataFrame, key: str, row_id: str, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """Left join of a table with unique ``key`` to one with any number of rows per key.

    A left outer join cannot split its right side, so a key with more than
    ``slot_rows`` rows is spread over several slots: the left row is repeated
    once per slot and each right row goes to one of them.  At most
    rows / ``slot_rows`` keys are that large, so the list of hot keys is small
    enough to broadcast whatever the size of the tables.
    """
    hot = F.broadcast(
        right.groupBy(key)
        .agg(F.ceil(F.count("*") / slot_rows).cast("int").alias("_slots"))
        .filter("_slots > 1")
    )
    spread_left = left.join(hot, key, "left").selectExpr(
        *left.columns, "_slots", "explode(sequence(0, coalesce(_slots, 1) - 1)) AS _slot"
    )
    spread_right = right.join(hot, key, "left").selectExpr(
        *right.columns,
        f"CAST(coalesce(pmod(xxhash64({row_id}), _slots), 0) AS INT) AS _slot",
        "true AS _hit",
    )
    # A hot key has matches, so its empty slots are no unmatched rows.
    return (
        spread_left.join(spread_right, [key, "_slot"], "left")
        .filter("_hit OR _slots IS NULL")
        .drop("_slot", "_slots", "_hit")
    )
