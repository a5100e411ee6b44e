"""The change operators over the derived tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoints import new_folder
from ..functions.outputs import write_outputs
from ..operators import changes as C
from ..operators import reports as R
from .settings import AUDITOR, RUN_TS

HISTORIES = {"vaca": "estado_ordeno", "toro": "tipo_uso", "ternero": "estado_lactancia"}


def _pick(df, columns):
    return df.select(*(c.strip() for c in columns.split(",")))


def _scd2(t, kind, column):
    """Rows with key % 5 arrive as a batch on a snapshot built from the others."""
    table, key = f"tbl_{kind}_detalle", f"id_{kind}_detalle"
    rows = t.narrow(table).select(key, "id_animal", column, "fecha_inicio")
    empty = rows.withColumns(
        {"fecha_fin": F.lit(None).cast("date"), "es_vigente": F.lit(True)}
    )
    arriving = empty.filter(f"{key} % 5 = 0").withColumn("es_vigente", F.expr(f"{key} % 15 <> 0"))
    snapshot = C.scd2(empty.limit(0), empty.filter(f"{key} % 5 <> 0"), key)
    return C.scd2(snapshot, arriving, key)


def _scd2_sql(kind, column):
    key = f"id_{kind}_detalle"
    return f"""
        WITH filas AS (
            SELECT {key}, id_animal, {column}, fecha_inicio, {key} % 5 = 0 AS nueva,
                   {key} % 15 <> 0 OR {key} % 5 <> 0 AS vigente
            FROM tbl_{kind}_detalle),
        orden AS (
            SELECT *, lead(fecha_inicio) OVER (PARTITION BY id_animal ORDER BY nueva, {key}) AS cierra
            FROM filas WHERE vigente)
        SELECT {key}, id_animal, {column}, fecha_inicio, cierra AS fecha_fin, cierra IS NULL AS es_vigente
        FROM orden
        UNION ALL
        SELECT {key}, id_animal, {column}, fecha_inicio, NULL, false FROM filas WHERE NOT vigente"""


def _log(t):
    return t["tbl_auditoria_alerta"].drop("id_auditoria")


_AUDIT = (
    "id_alerta, modulo, id_animal, tipo, prioridad, fecha_programada, estado_anterior, "
    "estado_nuevo, accion_auditoria, usuario_auditor"
)
_MOV = "tbl_movimiento_insumo"
_LARGE = "fx_movimiento_grande"


def _named_parties(rows):
    return rows.selectExpr(
        "*",
        "if(id_mov_insumo % 2 = 0, concat('Casa ', id_mov_insumo % 9), NULL) AS proveedor",
        "if(id_mov_insumo % 3 = 0, concat('Finca ', id_mov_insumo % 8), NULL) AS cliente",
        "if(id_mov_insumo % 5 = 0, concat('f', id_mov_insumo, '.pdf'), NULL) AS factura_url",
        "CAST(id_mov_insumo % 10 AS INT) AS id_usuario",
    )


def _new_alerts(t):
    return t["fx_alerta_despues"].withColumns(
        {"id_origen": F.lit(None).cast("bigint"), "descripcion": F.lit(None).cast("string")}
    )


def _health(t):
    alerts = t["fx_alerta_sanidad"].withColumns(
        {
            "id_origen": F.lit(None).cast("bigint"),
            "descripcion": F.lit(None).cast("string"),
            "fecha_atendida": F.lit(None).cast("timestamp_ntz"),
        }
    )
    return C.cerrar_alertas_sanidad(
        t["tbl_programacion_sanitaria"],
        t["fx_programacion_despues"],
        t["tbl_registro_sanitario_animal"],
        alerts,
        AUDITOR,
        RUN_TS,
    )


def _registered(t):
    """The tables after a batch of movements, as written by the job."""
    out = C.registrar_movimientos(t["tbl_insumo"], _named_parties(t[_LARGE]))
    return write_outputs(out, new_folder(t.spark, "movimientos"))


def _cycles(t):
    return C.sincronizar_ciclos(
        t["tbl_ciclo_reproductivo"],
        t["fx_ciclo_despues"],
        t["tbl_vaca_detalle"],
        t["tbl_alerta_reproductiva"],
    )


QUERIES = {
    "aplicar_mortalidad__tbl_animal": lambda t: C.aplicar_mortalidad(
        t["fx_animal_activo"], t["tbl_mortalidad"]
    )["tbl_animal"].select("id_animal", "estado_animal"),
    "aplicar_mortalidad__tbl_animal_auditoria": lambda t: C.aplicar_mortalidad(
        t["fx_animal_activo"], t["tbl_mortalidad"]
    )["tbl_animal_auditoria"],
    "aplicar_bajas__tbl_animal": lambda t: C.aplicar_bajas(t["fx_animal_activo"], t["tbl_baja_animal"])[
        "tbl_animal"
    ].select("id_animal", "estado_animal"),
    "aplicar_bajas__tbl_animal_auditoria": lambda t: C.aplicar_bajas(
        t["fx_animal_activo"], t["tbl_baja_animal"]
    )["tbl_animal_auditoria"],
    "aplicar_pesajes": lambda t: C.aplicar_pesajes(t["fx_animal_activo"], t["tbl_pesaje"]).select(
        "id_animal", "arete", "peso_actual_kg"
    ),
    "scd2_vaca": lambda t: _scd2(t, "vaca", HISTORIES["vaca"]),
    "scd2_toro": lambda t: _scd2(t, "toro", HISTORIES["toro"]),
    "scd2_ternero": lambda t: _scd2(t, "ternero", HISTORIES["ternero"]),
    "saldo_insumos": lambda t: C.saldo_insumos(t["tbl_insumo"], t[_MOV]).select(
        "id_insumo", "nombre", "stock_actual"
    ),
    "auditar_alertas_alta": lambda t: _pick(
        C.auditar_alertas_alta(t["tbl_alerta"], AUDITOR, RUN_TS), _AUDIT
    ),
    "auditar_alertas_cambio": lambda t: _pick(
        C.auditar_alertas_cambio(t["tbl_alerta"], _new_alerts(t), AUDITOR, RUN_TS), _AUDIT
    ),
    "auditar_alertas_baja": lambda t: _pick(
        C.auditar_alertas_baja(t["tbl_alerta"], _new_alerts(t), _log(t), AUDITOR, RUN_TS), _AUDIT
    ),
    "aplicar_movimientos_manga": lambda t: C.aplicar_movimientos_manga(
        t["fx_animal_activo"], t["tbl_movimiento_manga"]
    ).select("id_animal", "arete", "id_manga_actual"),
    "sincronizar_ciclos__tbl_vaca_detalle": lambda t: t.once(_cycles)["tbl_vaca_detalle"].select(
        "id_vaca_detalle", "id_animal", "estado_reproductivo", "es_vigente"
    ),
    "sincronizar_ciclos__tbl_alerta_reproductiva": lambda t: t.once(_cycles)["tbl_alerta_reproductiva"].select(
        "id_alerta", "id_ciclo", "tipo_alerta", "estado_alerta"
    ),
    "revertir_ciclos_borrados": lambda t: C.revertir_ciclos_borrados(
        t["tbl_ciclo_reproductivo"], t["fx_ciclo_quedan"], t["tbl_vaca_detalle"]
    ).select("id_vaca_detalle", "id_animal", "estado_reproductivo", "es_vigente"),
    "cerrar_alertas_sanidad__tbl_alerta": lambda t: t.once(_health)["tbl_alerta"].select(
        "id_alerta", "id_animal", "fecha_programada", "estado", "fecha_atendida"
    ),
    "cerrar_alertas_sanidad__tbl_auditoria_alerta": lambda t: _pick(
        t.once(_health)["tbl_auditoria_alerta"], _AUDIT
    ),
    "contabilizar_compras": lambda t: C.contabilizar_compras(t[_MOV], t["tbl_insumo"]),
    "contabilizar_ventas": lambda t: C.contabilizar_ventas(t[_MOV], t["tbl_insumo"]),
    "saldo_insumos__con_rechazos": lambda t: C.saldo_insumos(t["tbl_insumo"], t[_LARGE]).select(
        "id_insumo", "stock_actual"
    ),
    "saldo_insumos__rechazadas": lambda t: C.saldos_rechazados(t["tbl_insumo"], t[_LARGE]),
    "contabilizar__con_rechazos": lambda t: C.contabilizar_compras(_named_parties(t[_LARGE]), t["tbl_insumo"])
    .unionByName(C.contabilizar_ventas(_named_parties(t[_LARGE]), t["tbl_insumo"]))
    .select("id_mov_insumo", "categoria", "descripcion", "monto", "id_usuario"),
    "contabilizar__rechazadas": lambda t: C.asientos_rechazados(t[_LARGE]),
    "registrar_movimientos__stock_bajo": lambda t: R.stock_bajo(t.once(_registered)["tbl_insumo"]),
    "registrar_movimientos__resumen": lambda t: R.resumen_financiero_mensual(
        t["tbl_transaccion_financiera"]
        .select("fecha_transaccion", "categoria", "monto")
        .unionByName(
            t.once(_registered)["tbl_transaccion_financiera"].select("fecha_transaccion", "categoria", "monto")
        )
    ),
    "registrar_movimientos__rechazadas": lambda t: t.once(_registered)["rechazadas"],
}


def _retired(table, state):
    return f"""
        SELECT id_animal, CASE WHEN id_animal IN (SELECT id_animal FROM {table}) THEN '{state}'
               ELSE estado_animal END AS estado_animal FROM fx_animal_activo"""


def _ledger(kind, verb, text, where):
    return f"""
        SELECT '{kind}' AS categoria, m.fecha_movimiento AS fecha_transaccion,
               '{verb}: ' || coalesce(i.nombre, 'Insumo Desconocido') AS concepto, {text} AS descripcion,
               CAST(m.cantidad * m.precio_unitario AS DECIMAL(12,2)) AS monto, 'ejecutado' AS estado,
               '{verb} Insumo' AS tipo_origen, m.id_mov_insumo, CAST(NULL AS INT) AS id_usuario
        FROM tbl_movimiento_insumo m LEFT JOIN tbl_insumo i ON m.id_insumo = i.id_insumo
        WHERE m.tipo_movimiento = '{verb}' AND m.precio_unitario > 0 {where}"""


_CLOSED = """
        WITH dosis AS (
            SELECT DISTINCT n.id_registro_san, n.fecha_programada AS dia
            FROM fx_programacion_despues n JOIN tbl_programacion_sanitaria o
              ON o.id_programacion = n.id_programacion
            WHERE o.estado <> 'Aplicado' AND n.estado = 'Aplicado'),
        tratado AS (
            SELECT DISTINCT r.id_animal, CAST(d.dia AS DATE) AS dia
            FROM dosis d JOIN tbl_registro_sanitario_animal r ON r.id_registro_san = d.id_registro_san),
        cierra AS (
            SELECT a.id_alerta FROM fx_alerta_sanidad a JOIN tratado x
              ON x.id_animal = a.id_animal AND x.dia = CAST(a.fecha_programada AS DATE)
            WHERE a.estado = 'Pendiente' AND a.modulo = 'Sanidad')
"""
_PHASES = """
        WITH cambio AS (
            SELECT n.id_ciclo, n.id_animal, o.estado_ciclo AS antes, n.estado_ciclo AS ahora
            FROM fx_ciclo_despues n JOIN tbl_ciclo_reproductivo o ON o.id_ciclo = n.id_ciclo
            WHERE n.estado_ciclo <> o.estado_ciclo)
"""

_BALANCE = """
        WITH neto AS (
            SELECT id_insumo, sum(CASE WHEN tipo_movimiento IN ('Compra', 'Producción') THEN cantidad
                                       WHEN tipo_movimiento <> 'Ajuste' THEN -cantidad ELSE 0 END) AS delta
            FROM fx_movimiento_grande GROUP BY id_insumo),
        saldo AS (
            SELECT i.id_insumo, i.stock_actual, i.stock_actual + coalesce(n.delta, 0) AS nuevo,
                   abs(i.stock_actual + coalesce(n.delta, 0)) < 100000000 AS cabe
            FROM tbl_insumo i LEFT JOIN neto n USING (id_insumo))
"""
_POSTED = """
        WITH asiento AS (
            SELECT *, round(cantidad * precio_unitario, 2) AS importe
            FROM fx_movimiento_grande
            WHERE precio_unitario > 0 AND (tipo_movimiento = 'Compra'
                  OR (tipo_movimiento = 'Venta' AND destino_venta = 'Venta')))
"""

ORACLE = {
    "aplicar_mortalidad__tbl_animal": _retired("tbl_mortalidad", "Fallecido"),
    "aplicar_mortalidad__tbl_animal_auditoria": """
        SELECT id_animal, 'Muerte' AS accion, 'Activo' AS estado_anterior, 'Fallecido' AS estado_nuevo,
               'Registro automático por mortalidad' AS motivo, fecha_muerte AS fecha_evento
        FROM tbl_mortalidad""",
    "aplicar_bajas__tbl_animal": _retired("tbl_baja_animal", "Vendido"),
    "aplicar_bajas__tbl_animal_auditoria": """
        SELECT id_animal, 'Venta' AS accion, 'Activo' AS estado_anterior, 'Vendido' AS estado_nuevo,
               'Baja tipo: ' || tipo_baja AS motivo, fecha_baja AS fecha_evento
        FROM tbl_baja_animal""",
    "aplicar_pesajes": """
        SELECT a.id_animal, a.arete, coalesce(p.peso_kg, a.peso_actual_kg) AS peso_actual_kg
        FROM fx_animal_activo a LEFT JOIN tbl_pesaje p ON p.id_pesaje =
             (SELECT max(x.id_pesaje) FROM tbl_pesaje x WHERE x.id_animal = a.id_animal)""",
    "aplicar_movimientos_manga": """
        SELECT a.id_animal, a.arete, coalesce(p.id_manga_destino, a.id_manga_actual) AS id_manga_actual
        FROM fx_animal_activo a LEFT JOIN tbl_movimiento_manga p ON p.id_movimiento =
             (SELECT max(x.id_movimiento) FROM tbl_movimiento_manga x WHERE x.id_animal = a.id_animal)""",
    **{f"scd2_{kind}": _scd2_sql(kind, column) for kind, column in HISTORIES.items()},
    "saldo_insumos": """
        SELECT i.id_insumo, i.nombre, CAST(i.stock_actual
               + coalesce(sum(m.cantidad) FILTER (m.tipo_movimiento IN ('Compra', 'Producción')), 0)
               - coalesce(sum(m.cantidad) FILTER (m.tipo_movimiento IN ('Venta', 'Consumo')), 0)
               AS DECIMAL(10,2)) AS stock_actual
        FROM tbl_insumo i LEFT JOIN tbl_movimiento_insumo m ON m.id_insumo = i.id_insumo
        GROUP BY i.id_insumo, i.nombre, i.stock_actual""",
    "auditar_alertas_alta": f"""
        SELECT id_alerta, modulo, id_animal, tipo, prioridad, fecha_programada, 'N/A' AS estado_anterior,
               estado AS estado_nuevo, 'Creada' AS accion_auditoria, '{AUDITOR}' AS usuario_auditor
        FROM tbl_alerta""",
    "auditar_alertas_cambio": f"""
        SELECT n.id_alerta, n.modulo, n.id_animal, n.tipo, n.prioridad, n.fecha_programada,
               o.estado AS estado_anterior, n.estado AS estado_nuevo,
               CASE n.estado WHEN 'Atendida' THEN 'Atendida' WHEN 'Cancelada' THEN 'Cancelada'
                    ELSE 'Modificada' END AS accion_auditoria, '{AUDITOR}' AS usuario_auditor
        FROM fx_alerta_despues n JOIN tbl_alerta o ON o.id_alerta = n.id_alerta
        WHERE o.estado <> n.estado""",
    "auditar_alertas_baja": f"""
        SELECT CASE WHEN EXISTS (SELECT 1 FROM fx_alerta_despues n WHERE n.id_alerta = l.id_alerta)
                    THEN l.id_alerta END AS id_alerta,
               modulo, id_animal, tipo, prioridad, fecha_programada, estado_anterior, estado_nuevo,
               accion_auditoria, usuario_auditor
        FROM tbl_auditoria_alerta l
        UNION ALL
        SELECT NULL, modulo, id_animal, tipo, prioridad, fecha_programada, estado, NULL, 'Eliminada',
               '{AUDITOR}'
        FROM tbl_alerta o
        WHERE NOT EXISTS (SELECT 1 FROM fx_alerta_despues n WHERE n.id_alerta = o.id_alerta)""",
    "sincronizar_ciclos__tbl_vaca_detalle": _PHASES
    + """
        , ultimo AS (
            SELECT id_animal, CASE WHEN ahora LIKE 'Preñez%' THEN 'Preñada' ELSE 'Vacía' END AS vaca
            FROM cambio c WHERE id_ciclo = (SELECT max(id_ciclo) FROM cambio d WHERE d.id_animal = c.id_animal
                                            AND d.ahora <> 'Pendiente Palpación 1'))
        SELECT v.id_vaca_detalle, v.id_animal,
               CASE WHEN v.es_vigente AND u.vaca IS NOT NULL THEN u.vaca ELSE v.estado_reproductivo END
                   AS estado_reproductivo, v.es_vigente
        FROM tbl_vaca_detalle v LEFT JOIN ultimo u ON u.id_animal = v.id_animal""",
    "sincronizar_ciclos__tbl_alerta_reproductiva": _PHASES
    + """
        SELECT a.id_alerta, a.id_ciclo, a.tipo_alerta,
               CASE WHEN a.estado_alerta = 'Pendiente' AND EXISTS (
                   SELECT 1 FROM cambio c WHERE c.id_ciclo = a.id_ciclo AND a.tipo_alerta = CASE
                       WHEN c.antes = 'Pendiente Palpación 1' AND c.ahora IN ('Preñez Provisional', 'Vacía')
                           THEN 'Palpación 1'
                       WHEN c.antes = 'Preñez Provisional' AND c.ahora IN ('Preñez Confirmada', 'Vacía')
                           THEN 'Palpación 2'
                       WHEN c.antes = 'Preñez Confirmada' AND c.ahora IN ('Parto Exitoso', 'Abortado')
                           THEN 'Parto Estimado' END)
                   THEN 'Completada' ELSE a.estado_alerta END AS estado_alerta
        FROM tbl_alerta_reproductiva a""",
    "revertir_ciclos_borrados": """
        SELECT v.id_vaca_detalle, v.id_animal, CASE WHEN v.es_vigente AND EXISTS (
                   SELECT 1 FROM tbl_ciclo_reproductivo c WHERE c.id_animal = v.id_animal
                   AND c.id_ciclo NOT IN (SELECT id_ciclo FROM fx_ciclo_quedan))
               THEN 'Vacía' ELSE v.estado_reproductivo END AS estado_reproductivo, v.es_vigente
        FROM tbl_vaca_detalle v""",
    "cerrar_alertas_sanidad__tbl_alerta": _CLOSED
    + f"""
        SELECT a.id_alerta, a.id_animal, a.fecha_programada,
               CASE WHEN c.id_alerta IS NULL THEN a.estado ELSE 'Atendida' END AS estado,
               CASE WHEN c.id_alerta IS NOT NULL THEN TIMESTAMP '{RUN_TS}' END AS fecha_atendida
        FROM fx_alerta_sanidad a LEFT JOIN cierra c ON c.id_alerta = a.id_alerta""",
    "cerrar_alertas_sanidad__tbl_auditoria_alerta": _CLOSED
    + f"""
        SELECT a.id_alerta, a.modulo, a.id_animal, a.tipo, a.prioridad, a.fecha_programada,
               'Pendiente' AS estado_anterior, 'Atendida' AS estado_nuevo, 'Atendida' AS accion_auditoria,
               '{AUDITOR}' AS usuario_auditor
        FROM fx_alerta_sanidad a JOIN cierra c ON c.id_alerta = a.id_alerta""",
    "contabilizar_compras": _ledger(
        "gasto",
        "Compra",
        "'Proveedor: N/A | Cant: ' || CAST(m.cantidad AS VARCHAR) || ' | Factura: S/F'",
        "",
    ),
    "contabilizar_ventas": _ledger(
        "ingreso",
        "Venta",
        "'Cliente: N/A | Cant: ' || CAST(m.cantidad AS VARCHAR)",
        "AND m.destino_venta = 'Venta'",
    ),
    "saldo_insumos__con_rechazos": _BALANCE
    + "SELECT id_insumo, CASE WHEN cabe THEN CAST(nuevo AS DECIMAL(10,2)) ELSE stock_actual END AS stock_actual FROM saldo",
    "saldo_insumos__rechazadas": _BALANCE
    + "SELECT id_insumo, 'importe fuera de rango' AS motivo FROM saldo WHERE NOT cabe",
    "contabilizar__con_rechazos": _POSTED
    + """SELECT id_mov_insumo, CASE tipo_movimiento WHEN 'Compra' THEN 'gasto' ELSE 'ingreso' END AS categoria,
               CASE tipo_movimiento WHEN 'Compra' THEN
                   'Proveedor: ' || CASE WHEN id_mov_insumo % 2 = 0 THEN 'Casa ' || (id_mov_insumo % 9) ELSE 'N/A' END
                   || ' | Cant: ' || cantidad || ' | Factura: '
                   || CASE WHEN id_mov_insumo % 5 = 0 THEN 'f' || id_mov_insumo || '.pdf' ELSE 'S/F' END
               ELSE 'Cliente: ' || CASE WHEN id_mov_insumo % 3 = 0 THEN 'Finca ' || (id_mov_insumo % 8) ELSE 'N/A' END
                   || ' | Cant: ' || cantidad END AS descripcion,
               CAST(importe AS DECIMAL(12,2)) AS monto, CAST(id_mov_insumo % 10 AS INT) AS id_usuario
        FROM asiento WHERE importe < 10000000000""",
    "registrar_movimientos__stock_bajo": _BALANCE
    + """, aplicado AS (
            SELECT i.*, CASE WHEN s.cabe THEN CAST(s.nuevo AS DECIMAL(10,2)) ELSE s.stock_actual END AS hay
            FROM tbl_insumo i JOIN saldo s USING (id_insumo))
        SELECT id_insumo, nombre, unidad, hay AS stock_actual, stock_minimo,
               CAST(hay - stock_minimo AS DECIMAL(11,2)) AS diferencia
        FROM aplicado WHERE activo AND hay <= stock_minimo""",
    "registrar_movimientos__resumen": _POSTED
    + """, todo AS (
            SELECT fecha_transaccion AS dia, categoria, monto FROM tbl_transaccion_financiera
            UNION ALL
            SELECT fecha_movimiento, CASE tipo_movimiento WHEN 'Compra' THEN 'gasto' ELSE 'ingreso' END, importe
            FROM asiento WHERE importe < 10000000000)
        SELECT year(dia) AS anio, month(dia) AS mes,
               CAST(coalesce(sum(monto) FILTER (categoria = 'ingreso'), 0) AS DECIMAL(38,2)) AS total_ingresos,
               CAST(coalesce(sum(monto) FILTER (categoria = 'gasto'), 0) AS DECIMAL(38,2)) AS total_gastos,
               CAST(coalesce(sum(monto) FILTER (categoria = 'ingreso'), 0)
                    - coalesce(sum(monto) FILTER (categoria = 'gasto'), 0) AS DECIMAL(38,2)) AS balance
        FROM todo GROUP BY 1, 2""",
    "registrar_movimientos__rechazadas": _BALANCE
    + ", " + _POSTED.strip().removeprefix("WITH ")
    + """
        SELECT 'saldo' AS destino, CAST(id_insumo AS BIGINT) AS id, 'importe fuera de rango' AS motivo
        FROM saldo WHERE NOT cabe
        UNION ALL
        SELECT 'asiento', id_mov_insumo, 'importe fuera de rango' FROM asiento WHERE importe >= 10000000000""",
    "contabilizar__rechazadas": _POSTED
    + "SELECT id_mov_insumo, 'importe fuera de rango' AS motivo FROM asiento WHERE importe >= 10000000000",
}
