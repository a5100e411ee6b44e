"""Change operators that rewrite only the key ranges a batch touches, with their oracle SQL.

The snapshot holds the log up to a position; the batch is what the log brought since.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoints import new_folder
from ..functions.snapshots import read_snapshot, update_snapshot, write_snapshot
from ..operators import changes as C
from . import changes

#: Ranges of a snapshot, and the part of the log (by key) that the batch is.
RANGES, BATCH_SHARE = 64, 0.01


def _highest(rows, key):
    return rows.agg(F.max(key)).first()[0] or 0


def width_of(snapshot, key):
    """Keys of a range, so that a snapshot has RANGES of them."""
    return _highest(snapshot, key) // RANGES + 1


def since(log, key):
    """The log up to a position, and since."""
    position = int(_highest(log, key) * (1 - BATCH_SHARE))
    return log.filter(F.col(key) <= position), log.filter(F.col(key) > position)


def _applied(t, snapshot, key, batch, change, batch_key=None):
    """``snapshot`` written by key range, ``batch`` applied to the ranges it touches, all read back."""
    folder, width = new_folder(t.spark, "estado"), width_of(snapshot, key)
    write_snapshot(snapshot, key, folder, width)
    update_snapshot(folder, batch.withColumnRenamed(batch_key or key, key), key, change, snapshot, width)
    return read_snapshot(t.spark, folder, snapshot)


def _animals(t, table, log_key, apply):
    before, batch = since(t[table], log_key)
    snapshot = apply(t["fx_animal_activo"], before)
    return _applied(t, snapshot, "id_animal", batch, lambda rows: apply(rows, batch))


def _stock(t):
    before, batch = since(t["tbl_movimiento_insumo"], "id_mov_insumo")
    snapshot = C.saldo_insumos(t["tbl_insumo"], before)
    return _applied(t, snapshot, "id_insumo", batch, lambda rows: C.saldo_insumos(rows, batch))


def _history(t, kind, column):
    key = f"id_{kind}_detalle"
    rows = t.narrow(f"tbl_{kind}_detalle").select(key, "id_animal", column, "fecha_inicio")
    rows = rows.withColumns({"fecha_fin": F.lit(None).cast("date"), "es_vigente": F.lit(True)})
    before, batch = since(rows, key)
    snapshot = C.scd2(rows.limit(0), before, key)
    return _applied(t, snapshot, "id_animal", batch, lambda old: C.scd2(old, batch, key))


def _history_sql(kind, column):
    key = f"id_{kind}_detalle"
    closes = f"lead(fecha_inicio) OVER (PARTITION BY id_animal ORDER BY {key})"
    return f"""
        SELECT {key}, id_animal, {column}, fecha_inicio, {closes} AS fecha_fin, {closes} IS NULL AS es_vigente
        FROM tbl_{kind}_detalle"""


QUERIES = {
    "aplicar_mortalidad__parcial": lambda t: _animals(
        t, "tbl_mortalidad", "id_mortalidad", lambda a, b: C.aplicar_mortalidad(a, b)["tbl_animal"]
    ).select("id_animal", "estado_animal"),
    "aplicar_bajas__parcial": lambda t: _animals(
        t, "tbl_baja_animal", "id_baja", lambda a, b: C.aplicar_bajas(a, b)["tbl_animal"]
    ).select("id_animal", "estado_animal"),
    "aplicar_pesajes__parcial": lambda t: _animals(t, "tbl_pesaje", "id_pesaje", C.aplicar_pesajes).select(
        "id_animal", "arete", "peso_actual_kg"
    ),
    "aplicar_movimientos_manga__parcial": lambda t: _animals(
        t, "tbl_movimiento_manga", "id_movimiento", C.aplicar_movimientos_manga
    ).select("id_animal", "arete", "id_manga_actual"),
    "saldo_insumos__parcial": lambda t: _stock(t).select("id_insumo", "nombre", "stock_actual"),
    **{
        f"scd2_{kind}__parcial": lambda t, kind=kind, column=column: _history(t, kind, column)
        for kind, column in changes.HISTORIES.items()
    },
}
ORACLE = {
    "aplicar_mortalidad__parcial": changes.ORACLE["aplicar_mortalidad__tbl_animal"],
    "aplicar_bajas__parcial": changes.ORACLE["aplicar_bajas__tbl_animal"],
    "aplicar_pesajes__parcial": changes.ORACLE["aplicar_pesajes"],
    "aplicar_movimientos_manga__parcial": changes.ORACLE["aplicar_movimientos_manga"],
    "saldo_insumos__parcial": changes.ORACLE["saldo_insumos"],
    **{f"scd2_{k}__parcial": _history_sql(k, column) for k, column in changes.HISTORIES.items()},
}
