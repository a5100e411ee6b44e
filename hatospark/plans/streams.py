"""The stream forms of the change operators, fed from the source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoints import new_folder
from ..functions.snapshots import read_snapshot, write_snapshot
from ..sources.derived import BASE, DERIVED
from ..streaming import microbatches as M
from . import changes
from .snapshots import width_of


def _stream(t, base, table):
    """A derived table as a stream over the files of its source."""
    rows = t.spark.readStream.schema(BASE[base]).parquet(f"{t.sf_dir}/{base}.parquet*")
    others = {n: t.base(n) for n in BASE if n != base and f"{{{n}}}" in DERIVED[table]}
    return t.spark.sql(DERIVED[table], **{base: rows}, **others)


def _kept(t, base, table, snapshot, key, write, follow):
    """``snapshot`` after a stream has kept it up to date."""
    folder, width = new_folder(t.spark, "estado"), width_of(snapshot, key)
    write(snapshot, key, folder, width)
    query = follow(_stream(t, base, table), folder, snapshot, new_folder(t.spark, "avance"), width)
    query.awaitTermination()
    return read_snapshot(t.spark, folder, snapshot)


def _animals(t, base, table, follow):
    return _kept(t, base, table, t["fx_animal_activo"], "id_animal", write_snapshot, follow)


def _balances(t):
    write = lambda rows, key, folder, width: M.write_balances(rows, folder, width)
    return _kept(t, "events", "tbl_movimiento_insumo", t["tbl_insumo"], "id_insumo", write, M.saldos)


def _ledger(t):
    folder = new_folder(t.spark, "lotes")
    rows = _stream(t, "events", "tbl_movimiento_insumo")
    reduce = lambda batch: M.asientos(t["tbl_insumo"])(_with_optional(batch))
    M.reduce_stream(rows, reduce, folder, new_folder(t.spark, "avance")).awaitTermination()
    # With no micro-batch there is nothing written; an empty table has the columns of an empty batch.
    empty = reduce(t.spark.createDataFrame([], rows.schema))
    return t.spark.read.schema(empty.withColumn("lote", F.lit(0)).schema).parquet(folder).drop("lote")


def _with_optional(batch):
    return batch.selectExpr(
        "*", "CAST(NULL AS STRING) AS proveedor", "CAST(NULL AS STRING) AS cliente",
        "CAST(NULL AS STRING) AS factura_url", "CAST(NULL AS INT) AS id_usuario",
    )


QUERIES = {
    "aplicar_pesajes__flujo": lambda t: _animals(t, "orders", "tbl_pesaje", M.pesajes).select(
        "id_animal", "arete", "peso_actual_kg"
    ),
    "aplicar_movimientos_manga__flujo": lambda t: _animals(
        t, "orders", "tbl_movimiento_manga", M.movimientos_manga
    ).select("id_animal", "arete", "id_manga_actual"),
    "saldo_insumos__flujo": lambda t: _balances(t).select("id_insumo", "nombre", "stock_actual"),
    "contabilizar__flujo": _ledger,
}
ORACLE = {
    "aplicar_pesajes__flujo": changes.ORACLE["aplicar_pesajes"],
    "aplicar_movimientos_manga__flujo": changes.ORACLE["aplicar_movimientos_manga"],
    "saldo_insumos__flujo": changes.ORACLE["saldo_insumos"],
    "contabilizar__flujo": changes.ORACLE["contabilizar_compras"]
    + " UNION ALL "
    + changes.ORACLE["contabilizar_ventas"],
}
