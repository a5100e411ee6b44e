"""Reports after a batch, from their groups and the batch, with their oracle SQL over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoints import new_folder
from ..operators import changes as C
from ..operators import maintenance as M
from ..operators import reports as R
from . import changes, reports
from .settings import AS_OF
from .snapshots import since


def _written(t, rows, name):
    """What a job before the batch left behind."""
    folder = new_folder(t.spark, name)
    rows.write.parquet(folder)
    return t.spark.read.schema(rows.schema).parquet(folder)


def _moved(t):
    before, batch = since(t["tbl_movimiento_manga"], "id_movimiento")
    animals = C.aplicar_movimientos_manga(t["fx_animal_activo"], before)
    groups = _written(t, M.cabezas(M.signed(animals)), "cabezas")
    old = animals.join(batch.select("id_animal").distinct(), "id_animal", "left_semi")
    delta = M.cabezas(M.signed(C.aplicar_movimientos_manga(old, batch), old))
    return M.inventario_de(M.merged(groups, delta), t["tbl_manga"])


def _posted(t):
    before, batch = since(t["tbl_transaccion_financiera"], "id_transaccion")
    groups = _written(t, M.importes(M.signed(before)), "importes")
    return M.resumen_de(M.merged(groups, M.importes(M.signed(batch))))


def _advanced(t):
    cycles = t["tbl_ciclo_reproductivo"]
    groups = _written(t, M.fases(M.signed(cycles)), "fases")
    batch = t["fx_ciclo_despues"].select("id_ciclo", F.col("estado_ciclo").alias("_nuevo"))
    both = cycles.join(batch, "id_ciclo").filter("estado_ciclo <> _nuevo")
    new = both.withColumn("estado_ciclo", F.col("_nuevo")).drop("_nuevo")
    return M.kpi_de(M.merged(groups, M.fases(M.signed(new, both.drop("_nuevo")))), AS_OF)


def _stock(t):
    before, batch = since(t["tbl_movimiento_insumo"], "id_mov_insumo")
    supplies = C.saldo_insumos(t["tbl_insumo"], before)
    report = _written(t, R.stock_bajo(supplies), "stock_bajo")
    old = supplies.join(batch.select("id_insumo").distinct(), "id_insumo", "left_semi")
    return M.stock_bajo_tras(report, C.saldo_insumos(old, batch))


QUERIES = {
    "inventario_mangas__tras_lote": _moved,
    "stock_bajo__tras_lote": _stock,
    "resumen_financiero_mensual__tras_lote": _posted,
    "kpi_reproductivo__tras_lote": _advanced,
}


def _over(sql, table, rows):
    """``sql`` with ``rows`` in the place of ``table``."""
    return sql.replace(table, f"({rows})")


ORACLE = {
    "inventario_mangas__tras_lote": _over(
        reports.ORACLE["inventario_mangas"],
        "tbl_animal",
        f"SELECT *, 'Activo' AS estado_animal FROM ({changes.ORACLE['aplicar_movimientos_manga']})",
    ),
    "stock_bajo__tras_lote": _over(
        reports.ORACLE["stock_bajo"],
        "tbl_insumo",
        f"SELECT i.* EXCLUDE (stock_actual), s.stock_actual FROM tbl_insumo i "
        f"JOIN ({changes.ORACLE['saldo_insumos']}) s USING (id_insumo)",
    ),
    "resumen_financiero_mensual__tras_lote": reports.ORACLE["resumen_financiero_mensual"],
    "kpi_reproductivo__tras_lote": _over(
        reports.ORACLE["kpi_reproductivo"],
        "tbl_ciclo_reproductivo",
        "SELECT c.* EXCLUDE (estado_ciclo), coalesce(n.estado_ciclo, c.estado_ciclo) AS estado_ciclo "
        "FROM tbl_ciclo_reproductivo c LEFT JOIN fx_ciclo_despues n ON n.id_ciclo = c.id_ciclo",
    ),
}
