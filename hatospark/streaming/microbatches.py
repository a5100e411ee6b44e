"""Change operators on streams of appended rows.

What a stream has to remember lies in Spark's state store, and what it yields lies in a snapshot by key
range (``functions/snapshots.py``) of which a micro-batch rewrites the ranges it touches:

- The last weight or pen of an animal is a streaming aggregation with one row of state per animal. A
  repeated or late log row cannot change a maximum, so repeated batches write the same rows.
- Movements add up, so a repeated one must not count. One bit per log key tells whether it was seen, in
  blocks of ``2**BLOCK_BITS`` consecutive keys; a block that has seen all its keys keeps no bits. Rows of
  any age are judged, none is dropped for being late.

Ledger rows are appended: a micro-batch writes a folder of its own, and a repeated one replaces it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.snapshots import WIDTH, update_snapshot, write_snapshot
from ..operators import changes as C

#: Log keys of a block of bits.
BLOCK_BITS = 16
#: Last micro-batch that changed a row of a balance snapshot.
BATCH = "lote"


def reduce_stream(
    rows: DataFrame, reduce: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str
) -> StreamingQuery:
    """Process what is available of a stream, one reduced table per micro-batch."""

    def write(batch: DataFrame, lote: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{folder}/lote={lote}")

    return _started(rows, "append", write, checkpoint)


def _started(rows: DataFrame, mode: str, write, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def asientos(insumo: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Ledger rows of purchases and sales."""
    return lambda batch: C.contabilizar_compras(batch, insumo).unionByName(
        C.contabilizar_ventas(batch, insumo)
    )


# -- last values ---------------------------------------------------------------------


def latest_stream(
    rows: DataFrame,
    key: str,
    value: str,
    order: str,
    target: str,
    folder: str,
    like: DataFrame,
    checkpoint: str,
    width: int = WIDTH,
) -> StreamingQuery:
    """Keep ``target`` of the snapshot in ``folder`` (rows as ``like``) at the value of the last log row."""

    def write(batch: DataFrame, lote: int) -> None:
        batch = batch.persist()
        update_snapshot(folder, batch, key, lambda old: C.apply_latest(old, batch, key, target), like, width)
        batch.unpersist()

    return _started(C.latest(rows, key, value, order), "update", write, checkpoint)


def pesajes(rows: DataFrame, folder: str, like: DataFrame, checkpoint: str, width: int = WIDTH) -> StreamingQuery:
    names = ("id_animal", "peso_kg", "id_pesaje", "peso_actual_kg")
    return latest_stream(rows, *names, folder, like, checkpoint, width)


def movimientos_manga(
    rows: DataFrame, folder: str, like: DataFrame, checkpoint: str, width: int = WIDTH
) -> StreamingQuery:
    names = ("id_animal", "id_manga_destino", "id_movimiento", "id_manga_actual")
    return latest_stream(rows, *names, folder, like, checkpoint, width)


# -- balances ------------------------------------------------------------------------


def first_seen(rows: DataFrame, log_key: str, bits: int = BLOCK_BITS) -> DataFrame:
    """The rows of a stream whose ``log_key`` (a number, never null) no earlier row had.

    State is a bit per key of the blocks that still miss keys, and a count for each complete block.
    """
    size = 1 << bits

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bitmap, n = state.get if state.exists else (bytes(size >> 3), 0)
        seen = np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool) if n < size else np.ones(size, bool)
        for part in parts:
            place = part[log_key].to_numpy(np.int64) & (size - 1)
            _, first = np.unique(place, return_index=True)
            first = first[~seen[place[first]]]
            seen[place[first]] = True
            n += len(first)
            yield part.iloc[np.sort(first)].drop(columns="_block")
        state.update((np.packbits(seen).tobytes() if n < size else b"", n))

    blocks = rows.withColumn("_block", F.shiftright(F.col(log_key).cast("bigint"), bits))
    return blocks.groupBy("_block").applyInPandasWithState(
        judge, rows.schema, "bitmap binary, n int", "append", GroupStateTimeout.NoTimeout
    )


def write_balances(insumo: DataFrame, folder: str, width: int = WIDTH) -> None:
    """The snapshot that ``saldos`` keeps: supplies, and the micro-batch that changed them last."""
    write_snapshot(insumo.withColumn(BATCH, F.lit(-1).cast("bigint")), "id_insumo", folder, width)


def saldos(
    rows: DataFrame, folder: str, like: DataFrame, checkpoint: str, width: int = WIDTH, bits: int = BLOCK_BITS
) -> StreamingQuery:
    """Keep the balances in ``folder`` (see ``write_balances``; other columns as ``like``) up to date.

    A balance that a micro-batch would take out of its range stays. A micro-batch that is repeated after a failure skips the
    supplies that it has changed already; so ``folder`` and ``checkpoint`` belong together.
    """
    like = like.withColumn(BATCH, F.lit(-1).cast("bigint"))

    def write(batch: DataFrame, lote: int) -> None:
        net = C.signed_totals(batch).persist()

        def change(old: DataFrame) -> DataFrame:
            done = F.col(BATCH) >= lote
            new = C.apply_totals(old.filter(~done), net)
            return new.withColumn(BATCH, F.lit(lote).cast("bigint")).unionByName(old.filter(done))

        update_snapshot(folder, net, "id_insumo", change, like, width)
        net.unpersist()

    needed = rows.select("id_mov_insumo", "id_insumo", "tipo_movimiento", "cantidad")
    return _started(first_seen(needed, "id_mov_insumo", bits), "append", write, checkpoint)
