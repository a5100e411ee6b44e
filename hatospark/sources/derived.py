"""Herd tables derived from the star-schema parquet files.

``DERIVED`` states each table as one SELECT in SQL that Spark and DuckDB both
read; ``{nation}`` and the like name a source file.  ``EXTRA`` and ``DIRTY``
add columns and planted errors for the data-quality jobs.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import next_value
from ..model.tables import TABLES
from ..operators.quality import fill_defaults, with_generated

# Stated so that reading a file does not start a job to infer its schema.
BASE = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

_N_PART = "(SELECT count(*) FROM {part})"
_MIN_PART = "(SELECT min(p_partkey) FROM {part})"
_N_CUST = "(SELECT count(*) FROM {customer})"
_MIN_CUST = "(SELECT min(c_custkey) FROM {customer})"
_MIN_SUPP = "(SELECT min(s_suppkey) FROM {supplier})"
_DAY = "CAST(o_orderdate AS DATE)"


def _history(key: str, remainder: int, columns: list[str]) -> str:
    return (
        f"SELECT {key}, id_animal, {', '.join(columns)}, fecha_inicio, sig AS fecha_fin, sig IS NULL AS es_vigente "
        f"FROM (SELECT o_orderkey AS {key}, o_custkey AS id_animal, {_DAY} AS fecha_inicio, "
        f"lead({_DAY}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sig "
        f"FROM {{orders}} WHERE o_custkey % 3 = {remainder}) x"
    )


HISTORY_COLUMNS = {
    "tbl_vaca_detalle": (
        "id_vaca_detalle",
        0,
        [
            "CASE WHEN id_vaca_detalle % 2 = 0 THEN 'Activo' ELSE 'Inactivo' END AS estado_ordeno",
            "CASE id_vaca_detalle % 5 WHEN 0 THEN 'Preñada' WHEN 1 THEN 'Parida' WHEN 2 THEN 'Vacía' "
            "WHEN 3 THEN 'Seca' ELSE 'Lactando' END AS estado_reproductivo",
        ],
    ),
    "tbl_toro_detalle": (
        "id_toro_detalle",
        1,
        [
            "CASE id_toro_detalle % 3 WHEN 0 THEN 'Semental' WHEN 1 THEN 'Ceba' ELSE 'Levante' END AS tipo_uso",
            "id_toro_detalle % 2 = 0 AS activo_reproduccion",
            "CASE id_toro_detalle % 4 WHEN 0 THEN 'Alta' WHEN 1 THEN 'Media' WHEN 2 THEN 'Baja' "
            "ELSE 'Sin evaluar' END AS libido_evaluacion",
        ],
    ),
    "tbl_ternero_detalle": (
        "id_ternero_detalle",
        2,
        [
            "CASE id_ternero_detalle % 3 WHEN 0 THEN 'Lactante' WHEN 1 THEN 'Pre-destete' "
            "ELSE 'Destetado' END AS estado_lactancia",
            "CAST((id_ternero_detalle % 2000 + 2500) / 100.0 AS DECIMAL(6,2)) AS peso_nacimiento_kg",
            "CASE WHEN id_ternero_detalle % 3 = 2 THEN "
            "CAST((id_ternero_detalle % 9000 + 12000) / 100.0 AS DECIMAL(6,2)) END AS peso_destete_kg",
        ],
    ),
}

_SCHEDULE = (
    "SELECT o_orderkey * 10 + k AS id_programacion, o_orderkey AS id_registro_san, "
    f"{_DAY} + CAST(7 * k AS INT) AS fecha_programada, "
    "CASE WHEN (o_orderkey + k) % 3 = 0 THEN 'Aplicado' ELSE 'Pendiente' END AS estado "
)

DERIVED = {
    "tbl_rol": "SELECT r_regionkey + 1 AS id_rol, r_name AS nombre_rol FROM {region}",
    "tbl_usuario": "SELECT s_suppkey AS id_usuario, s_name AS nombre_completo FROM {supplier}",
    "tbl_colaborador": "SELECT s_suppkey AS id_colaborador, s_name AS nombre FROM {supplier}",
    "tbl_raza": """
        SELECT n_nationkey + 1 AS id_raza, n_name AS nombre_raza,
               CASE n_nationkey % 3 WHEN 0 THEN 'Carne' WHEN 1 THEN 'Lecheria'
                    ELSE 'Doble Propósito' END AS proposito
        FROM {nation}""",
    "tbl_procedencia": "SELECT r_regionkey + 1 AS id_procedencia, r_name AS nombre FROM {region}",
    "tbl_manga": """
        SELECT n_nationkey + 1 AS id_manga, 100 + n_nationkey AS numero_manga, n_name AS nombre,
               CASE n_nationkey % 3 WHEN 0 THEN 'Ordeño' WHEN 1 THEN 'Cría' ELSE 'Ceba' END AS funcion,
               CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE 20 * (1 + n_nationkey % 5) END AS capacidad_max
        FROM {nation}""",
    "tbl_causa": """
        SELECT n_nationkey + 1 AS id_causa,
               CASE n_nationkey % 3 WHEN 0 THEN 'Digestivo' WHEN 1 THEN 'Diarrea'
                    ELSE 'Otros' END AS causa_principal,
               CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS detalle_causa
        FROM {nation}""",
    "tbl_animal": """
        SELECT c_custkey AS id_animal, c_name AS arete,
               lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0') AS trazabilidad,
               CASE c_custkey % 3 WHEN 0 THEN 'Vaca' WHEN 1 THEN 'Toro' ELSE 'Ternero' END AS tipo_animal,
               CASE WHEN c_custkey % 3 = 0 THEN 'F' WHEN c_custkey % 3 = 1 THEN 'M'
                    WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sexo,
               c_nationkey + 1 AS id_raza,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 22 + 1 END AS id_manga_actual,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 5 + 1 END AS id_procedencia,
               DATE '1988-01-31' + CAST(c_custkey * 37 % 3650 AS INT) AS fecha_nacimiento,
               CAST((c_custkey * 7919 % 60000 + 4000) / 100.0 AS DECIMAL(7,2)) AS peso_actual_kg,
               CASE c_custkey % 10 WHEN 0 THEN 'Fallecido' WHEN 1 THEN 'Vendido'
                    WHEN 2 THEN 'Inactivo' ELSE 'Activo' END AS estado_animal
        FROM {customer}""",
    **{name: _history(*spec) for name, spec in HISTORY_COLUMNS.items()},
    "tbl_toro_monta_natural": """
        SELECT o_orderkey AS id_monta_natural, o_orderkey AS id_toro_detalle,
               CAST(o_orderkey % 40 AS INT) AS num_montas_acumuladas
        FROM {orders} WHERE o_custkey % 3 = 1 AND o_orderkey % 2 = 0""",
    "tbl_toro_inseminacion": """
        SELECT o_orderkey AS id_inseminacion, o_orderkey AS id_toro_detalle,
               lpad(CAST(o_orderkey % 1000000 AS VARCHAR(20)), 6, '0') AS codigo_envase
        FROM {orders} WHERE o_custkey % 3 = 1 AND o_orderkey % 2 = 1""",
    "tbl_animal_auditoria": f"""
        SELECT o_orderkey AS id_auditoria, o_custkey AS id_animal,
               CASE o_orderkey % 4 WHEN 0 THEN 'Cambio Estado' WHEN 1 THEN 'Muerte'
                    WHEN 2 THEN 'Venta' ELSE 'Actualización' END AS accion,
               {_DAY} AS fecha_evento
        FROM {{orders}} WHERE o_orderkey % 3 = 0""",
    "tbl_movimiento_manga": """
        SELECT o_orderkey AS id_movimiento, o_custkey AS id_animal,
               o_orderkey % 22 + 1 AS id_manga_destino, o_orderdate AS fecha_movimiento
        FROM {orders}""",
    "tbl_pesaje": f"""
        SELECT o_orderkey AS id_pesaje, o_custkey AS id_animal, {_DAY} AS fecha_pesaje,
               CAST((o_orderkey * 131 % 60000 + 4000) / 100.0 AS DECIMAL(7,2)) AS peso_kg
        FROM {{orders}}""",
    "tbl_produccion_leche": f"""
        SELECT min(o_orderkey) AS id_produccion, o_custkey AS id_animal, {_DAY} AS fecha_ordeno,
               CAST((min(o_orderkey) % 1500 + 100) / 100.0 AS DECIMAL(6,2)) AS litros_manana,
               CAST((min(o_orderkey) % 1100) / 100.0 AS DECIMAL(6,2)) AS litros_tarde
        FROM {{orders}} WHERE o_custkey % 3 = 0 GROUP BY o_custkey, {_DAY}""",
    "tbl_producto_sanitario": "SELECT p_partkey AS id_producto, p_name AS nombre FROM {part}",
    "tbl_registro_sanitario": f"""
        SELECT o_orderkey AS id_registro_san,
               CASE o_orderkey % 3 WHEN 0 THEN 'Tratamiento' WHEN 1 THEN 'Vacunación'
                    ELSE 'Mastitis' END AS categoria,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL
                    ELSE o_orderkey % {_N_PART} + {_MIN_PART} END AS id_producto,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL
                    ELSE CAST((o_orderkey % 3000) / 100.0 AS DECIMAL(8,2)) END AS dosis_valor,
               'ml' AS dosis_unidad, {_DAY} AS fecha_aplicacion,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 25 + 1 END AS id_causa,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE o_orderkey % 10 + {_MIN_SUPP} END AS id_veterinario
        FROM {{orders}}""",
    "tbl_registro_sanitario_animal": f"""
        SELECT id_registro_san * {_N_CUST} + id_animal AS id_detalle, id_registro_san, id_animal,
               'Aplicado' AS estado_aplicacion
        FROM (SELECT DISTINCT l_orderkey AS id_registro_san,
                     l_partkey % {_N_CUST} + {_MIN_CUST} AS id_animal FROM {{lineitem}}) x""",
    "tbl_mastitis_cuartos": """
        SELECT o_orderkey AS id_mastitis, o_orderkey AS id_registro_san, o_custkey AS id_animal,
               CASE o_orderkey % 4 WHEN 0 THEN 'Sana' WHEN 1 THEN 'Subclínica' WHEN 2 THEN 'Leve'
                    ELSE 'Moderada' END AS cuarto_ad
        FROM {orders} WHERE o_orderkey % 3 = 2""",
    "tbl_programacion_sanitaria": _SCHEDULE
    + "FROM {orders} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) ks WHERE o_orderkey % 4 <> 1",
    "tbl_detalle_aplicacion_sanitaria": """
        SELECT o_orderkey AS id_aplicacion, o_orderkey AS id_registro_san, o_custkey AS id_animal,
               CAST((o_orderkey % 3000 + 1) / 100.0 AS DECIMAL(8,2)) AS dosis_valor, 'ml' AS dosis_unidad,
               o_orderdate AS fecha_aplicacion
        FROM {orders} WHERE o_orderkey % 2 = 0""",
    "tbl_ciclo_reproductivo": f"""
        SELECT o_orderkey AS id_ciclo, o_custkey AS id_animal, {_DAY} AS fecha_inicio,
               CASE WHEN o_orderkey % 2 = 0 THEN 'Monta Natural'
                    ELSE 'Inseminación Artificial' END AS tipo_evento,
               CASE o_orderkey % 6 WHEN 0 THEN 'Pendiente Palpación 1' WHEN 1 THEN 'Preñez Provisional'
                    WHEN 2 THEN 'Vacía' WHEN 3 THEN 'Preñez Confirmada' WHEN 4 THEN 'Parto Exitoso'
                    ELSE 'Abortado' END AS estado_ciclo,
               CASE WHEN o_orderkey % 6 >= 4 THEN {_DAY} + 283 END AS fecha_parto_real,
               CASE o_orderkey % 6 WHEN 4 THEN 'Exitoso' WHEN 5 THEN 'Abortado' END AS resultado_parto
        FROM {{orders}} WHERE o_custkey % 3 = 0""",
    "tbl_alerta_reproductiva": f"""
        SELECT o_orderkey AS id_alerta, o_orderkey AS id_ciclo, o_custkey AS id_animal,
               CASE o_orderkey % 4 WHEN 0 THEN 'Palpación 1' WHEN 1 THEN 'Palpación 2'
                    WHEN 2 THEN 'Parto Estimado' ELSE 'Seguimiento de Celo' END AS tipo_alerta,
               {_DAY} + 30 AS fecha_programada,
               CASE WHEN o_orderkey % 5 = 0 THEN 'Completada' WHEN o_orderkey % 7 = 0 THEN 'Cancelada'
                    ELSE 'Pendiente' END AS estado_alerta
        FROM {{orders}} WHERE o_custkey % 3 = 0""",
    "tbl_mortalidad": f"""
        SELECT c_custkey AS id_mortalidad, c_custkey AS id_animal, c_custkey % 25 + 1 AS id_causa,
               DATE '1998-01-01' + CAST(c_custkey % 365 AS INT) AS fecha_muerte,
               CASE WHEN c_custkey % 20 = 0 THEN NULL
                    ELSE c_custkey % 10 + {_MIN_SUPP} END AS id_usuario
        FROM {{customer}} WHERE c_custkey % 10 = 0""",
    "tbl_baja_animal": """
        SELECT c_custkey AS id_baja, c_custkey AS id_animal,
               CASE c_custkey % 3 WHEN 0 THEN 'Venta' WHEN 1 THEN 'Donación' ELSE 'Descarte' END AS tipo_baja,
               DATE '1998-01-01' + CAST(c_custkey % 365 AS INT) AS fecha_baja,
               CAST((c_custkey * 977 % 900000 + 100000) / 100.0 AS DECIMAL(12,2)) AS precio_venta,
               CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_name END AS comprador
        FROM {customer} WHERE c_custkey % 10 = 1""",
    "tbl_categoria_insumo": """
        SELECT r_regionkey + 1 AS id_categoria_insumo, r_name AS nombre_categoria FROM {region}""",
    "tbl_insumo": """
        SELECT p_partkey AS id_insumo, p_name AS nombre, 'kg' AS unidad,
               CAST((p_partkey * 613 % 40000) / 100.0 AS DECIMAL(10,2)) AS stock_actual,
               CAST(p_size * 4 AS DECIMAL(10,2)) AS stock_minimo, p_partkey % 9 <> 0 AS activo
        FROM {part}""",
    "tbl_movimiento_insumo": f"""
        SELECT event_id AS id_mov_insumo, event_id % {_N_PART} + {_MIN_PART} AS id_insumo,
               CASE event_type WHEN 'purchase' THEN 'Compra' WHEN 'click' THEN 'Venta'
                    WHEN 'signup' THEN 'Producción' WHEN 'view' THEN 'Consumo'
                    ELSE 'Ajuste' END AS tipo_movimiento,
               CASE WHEN event_type <> 'click' THEN NULL WHEN event_id % 3 = 0 THEN 'Consumo Animal'
                    ELSE 'Venta' END AS destino_venta,
               CAST(value AS DECIMAL(10,2)) AS cantidad,
               CASE WHEN event_id % 7 = 0 THEN NULL
                    ELSE CAST((event_id % 5000) / 100.0 AS DECIMAL(10,2)) END AS precio_unitario,
               CAST(ts AS DATE) AS fecha_movimiento
        FROM {{events}}""",
    "tbl_produccion_concentrado_det": f"""
        SELECT event_id AS id_detalle, event_id AS id_mov_insumo,
               event_id * 7 % {_N_PART} + {_MIN_PART} AS id_insumo_usado,
               CAST(value AS DECIMAL(10,2)) AS cantidad_usada
        FROM {{events}} WHERE event_type = 'signup'""",
    "tbl_transaccion_financiera": f"""
        SELECT o_orderkey AS id_transaccion,
               CASE WHEN o_orderstatus = 'F' THEN 'gasto' ELSE 'ingreso' END AS categoria,
               {_DAY} AS fecha_transaccion, CAST(o_totalprice AS DECIMAL(12,2)) AS monto,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'pendiente' ELSE 'ejecutado' END AS estado
        FROM {{orders}}""",
    "tbl_transaccion_animal": """
        SELECT c_custkey AS id_trans_animal, c_custkey AS id_transaccion, c_custkey AS id_baja,
               CAST((c_custkey * 977 % 900000 + 100000) / 100.0 AS DECIMAL(12,2)) AS precio_acordado,
               CAST((c_custkey % 1200) / 100.0 AS DECIMAL(5,2)) AS comision_pct
        FROM {customer} WHERE c_custkey % 10 = 1""",
    "tbl_transaccion_leche": f"""
        SELECT o_orderkey AS id_trans_leche, o_orderkey AS id_transaccion, {_DAY} AS fecha_inicio,
               {_DAY} + 30 AS fecha_fin,
               CAST((o_orderkey % 90000 + 1) / 100.0 AS DECIMAL(10,2)) AS total_litros,
               CAST((o_orderkey % 9000 + 1000) / 10000.0 AS DECIMAL(8,4)) AS precio_litro,
               CAST(o_orderkey % 50 AS DECIMAL(12,2)) AS descuentos
        FROM {{orders}} WHERE o_orderkey % 10 = 0""",
    "tbl_alerta": f"""
        SELECT event_id AS id_alerta,
               CASE event_id % 3 WHEN 0 THEN 'Sanidad' WHEN 1 THEN 'General' ELSE 'Producción' END AS modulo,
               CASE WHEN event_id % 17 = 0 THEN NULL
                    ELSE event_id % {_N_CUST} + {_MIN_CUST} END AS id_animal,
               event_type AS tipo,
               CASE event_id % 3 WHEN 0 THEN 'Urgente' WHEN 1 THEN 'Normal' ELSE 'Baja' END AS prioridad,
               CAST(ts AS DATE) AS fecha_programada,
               CASE event_id % 4 WHEN 0 THEN 'Atendida' WHEN 1 THEN 'Cancelada'
                    ELSE 'Pendiente' END AS estado,
               CASE WHEN event_id % 5 = 0 THEN NULL
                    ELSE event_id % 10 + {_MIN_SUPP} END AS id_usuario_atiende
        FROM {{events}}""",
    "tbl_auditoria_alerta": f"""
        SELECT event_id AS id_auditoria,
               CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id END AS id_alerta,
               CASE event_id % 3 WHEN 0 THEN 'Sanidad' WHEN 1 THEN 'General' ELSE 'Producción' END AS modulo,
               CASE WHEN event_id % 17 = 0 THEN NULL
                    ELSE event_id % {_N_CUST} + {_MIN_CUST} END AS id_animal,
               event_type AS tipo,
               CASE event_id % 3 WHEN 0 THEN 'Urgente' WHEN 1 THEN 'Normal' ELSE 'Baja' END AS prioridad,
               CAST(ts AS DATE) AS fecha_programada, 'N/A' AS estado_anterior,
               'Pendiente' AS estado_nuevo, 'Creada' AS accion_auditoria, ts AS fecha_auditoria,
               'app@localhost' AS usuario_auditor
        FROM {{events}}""",
    "tbl_bitacora": f"""
        SELECT event_id AS id_bitacora, event_id % 10 + {_MIN_SUPP} AS id_usuario, 'INSERT' AS accion,
               'tbl_animal' AS tabla_afectada, CAST(user_id AS VARCHAR(20)) AS id_registro,
               props AS detalle, ts AS fecha_accion
        FROM {{events}}""",
}

# Reference columns the derived tables lack, some of them without a parent.
EXTRA = {
    "tbl_usuario": {
        "usuario": "lower(nombre_completo)",
        "email": "concat('U', CAST(id_usuario % 70 AS VARCHAR(20)), '@finca.org')",
        "id_rol": "id_usuario % 6 + 1",
        "estado": "CASE WHEN id_usuario % 20 = 0 THEN 'suspendido' ELSE 'activo' END",
    },
    "tbl_colaborador": {
        "id_usuario": "CASE WHEN id_colaborador % 8 = 0 THEN NULL WHEN id_colaborador % 9 = 0 "
        "THEN id_colaborador + 1000000 ELSE id_colaborador END",
        "id_rol": "id_colaborador % 5 + 1",
    },
    "tbl_toro_detalle": {
        "id_usuario_registro": "CASE WHEN id_toro_detalle % 7 = 0 THEN NULL ELSE id_toro_detalle % 12 END",
    },
    "tbl_ternero_detalle": {
        "id_madre": "CASE WHEN id_ternero_detalle % 4 = 0 THEN NULL ELSE id_animal - 2 END",
        "id_padre": "CASE WHEN id_ternero_detalle % 5 = 0 THEN -1 ELSE id_animal - 1 END",
    },
    "tbl_movimiento_manga": {
        "id_manga_origen": "CASE WHEN id_movimiento % 5 = 0 THEN NULL ELSE id_movimiento % 30 + 1 END",
        "id_usuario": "id_movimiento % 10",
    },
    "tbl_pesaje": {"id_usuario": "CASE WHEN id_pesaje % 3 = 0 THEN NULL ELSE id_pesaje % 11 END"},
    "tbl_producto_sanitario": {
        "tipo": "CASE id_producto % 3 WHEN 0 THEN 'Vacuna' WHEN 1 THEN 'Vitamina' ELSE 'Jarabe' END",
    },
    "tbl_registro_sanitario": {"id_usuario": "id_registro_san % 10"},
    "tbl_ciclo_reproductivo": {
        "id_veterinario_inicio": "id_ciclo % 10",
        "id_veterinario_palp1": "CASE WHEN id_ciclo % 6 = 0 THEN NULL ELSE id_ciclo % 11 END",
        "id_veterinario_palp2": "CASE WHEN id_ciclo % 6 >= 3 THEN id_ciclo % 10 END",
        "id_veterinario_parto": "CASE WHEN id_ciclo % 6 >= 4 THEN id_ciclo % 10 END",
        "fecha_palpacion1": "CASE WHEN id_ciclo % 25 = 0 THEN fecha_inicio - 1 "
        "WHEN id_ciclo % 6 > 0 THEN fecha_inicio + 30 END",
        "fecha_palpacion2": "CASE WHEN id_ciclo % 6 >= 3 THEN fecha_inicio + 60 END",
    },
    "tbl_baja_animal": {"id_causa": "id_baja % 30 + 1", "id_usuario": "id_baja % 10"},
    "tbl_insumo": {"id_categoria_insumo": "id_insumo % 7 + 1"},
    "tbl_movimiento_insumo": {"id_usuario": "id_mov_insumo % 10"},
    "tbl_transaccion_financiera": {
        "concepto": "CASE WHEN id_transaccion % 40 = 0 THEN NULL WHEN id_transaccion % 90 = 1 "
        "THEN repeat('x', 130) ELSE 'Asiento' END",
        "id_usuario": "id_transaccion % 10",
        "id_mov_insumo": "CASE WHEN id_transaccion % 3 = 0 THEN id_transaccion END",
    },
}

# Planted errors in columns the derived tables have.
DIRTY = {
    "tbl_animal": {
        "trazabilidad": "CASE WHEN id_animal % 50 = 0 THEN substr(trazabilidad, 2) "
        "WHEN id_animal % 70 = 1 THEN '000001' ELSE trazabilidad END",
        "arete": "CASE WHEN id_animal % 90 = 0 THEN 'sin  ARETE ' WHEN id_animal % 90 = 1 "
        "THEN 'Sin  árete' ELSE arete END",
        "sexo": "CASE WHEN id_animal % 40 = 0 THEN 'X' WHEN id_animal % 45 = 0 THEN NULL ELSE sexo END",
        "id_raza": "CASE WHEN id_animal % 60 = 0 THEN 99 ELSE id_raza END",
    },
    "tbl_manga": {"funcion": "CASE WHEN id_manga % 9 = 0 THEN 'Establo' ELSE funcion END"},
    "tbl_pesaje": {"peso_kg": "CASE WHEN id_pesaje % 100 = 0 THEN -peso_kg ELSE peso_kg END"},
    "tbl_movimiento_insumo": {
        "cantidad": "CASE WHEN id_mov_insumo % 200 = 0 THEN cantidad - cantidad ELSE cantidad END",
    },
    "tbl_transaccion_financiera": {
        "monto": "CASE WHEN id_transaccion % 300 = 0 THEN -monto ELSE monto END",
    },
    "tbl_toro_inseminacion": {
        "codigo_envase": "CASE WHEN id_inseminacion % 80 = 1 THEN 'AB1' ELSE codigo_envase END",
    },
    "tbl_alerta": {
        "tipo": "CASE WHEN id_alerta % 150 = 0 THEN NULL WHEN id_alerta % 150 = 1 "
        "THEN repeat('ñ', 121) ELSE tipo END",
    },
}

# Snapshots and request batches the change and command runs start from.
FIXTURES = {
    "fx_animal_activo": """
        SELECT id_animal, arete, tipo_animal, sexo, id_manga_actual, peso_actual_kg,
               'Activo' AS estado_animal
        FROM {tbl_animal}""",
    "fx_alerta_despues": """
        SELECT id_alerta, modulo, id_animal, tipo, prioridad, fecha_programada,
               CASE WHEN estado = 'Pendiente' AND id_alerta % 3 = 0 THEN 'Atendida'
                    WHEN estado = 'Pendiente' AND id_alerta % 3 = 1 THEN 'Cancelada'
                    WHEN estado = 'Cancelada' AND id_alerta % 8 = 1 THEN 'Pendiente'
                    ELSE estado END AS estado
        FROM {tbl_alerta} WHERE id_alerta % 11 <> 0""",
    "fx_ciclo": """
        SELECT id_ciclo, id_animal, fecha_inicio, tipo_evento, id_ciclo % 10 AS id_veterinario_inicio,
               fecha_inicio + 30 AS fecha_estimada_palp1, fecha_inicio + 60 AS fecha_estimada_palp2,
               fecha_inicio + 283 AS fecha_estimada_parto, estado_ciclo,
               CASE WHEN id_ciclo % 6 > 0 THEN fecha_inicio + 30 END AS fecha_palpacion1,
               CASE id_ciclo % 6 WHEN 0 THEN NULL WHEN 2 THEN 'Vacía' ELSE 'Preñada' END AS resultado_palpacion1,
               CASE WHEN id_ciclo % 6 > 0 THEN id_ciclo % 10 END AS id_veterinario_palp1,
               CASE WHEN id_ciclo % 6 >= 3 THEN fecha_inicio + 60 END AS fecha_palpacion2,
               CASE WHEN id_ciclo % 6 >= 3 THEN 'Preñada' END AS resultado_palpacion2,
               CASE WHEN id_ciclo % 6 >= 3 THEN id_ciclo % 10 END AS id_veterinario_palp2,
               fecha_parto_real, resultado_parto,
               CASE WHEN id_ciclo % 6 >= 4 THEN id_ciclo % 10 END AS id_veterinario_parto
        FROM {tbl_ciclo_reproductivo}""",
    "fx_ciclo_despues": """
        SELECT id_ciclo, id_animal,
               CASE WHEN id_ciclo % 5 = 0 THEN estado_ciclo
                    ELSE CASE estado_ciclo
                         WHEN 'Pendiente Palpación 1' THEN
                             CASE WHEN id_ciclo % 4 = 0 THEN 'Vacía' ELSE 'Preñez Provisional' END
                         WHEN 'Preñez Provisional' THEN
                             CASE WHEN id_ciclo % 4 = 1 THEN 'Vacía' ELSE 'Preñez Confirmada' END
                         WHEN 'Preñez Confirmada' THEN
                             CASE WHEN id_ciclo % 4 = 1 THEN 'Abortado' ELSE 'Parto Exitoso' END
                         WHEN 'Parto Exitoso' THEN 'Abortado'
                         WHEN 'Vacía' THEN
                             CASE WHEN id_ciclo % 3 = 0 THEN 'Pendiente Palpación 1' ELSE estado_ciclo END
                         ELSE estado_ciclo END END AS estado_ciclo
        FROM {tbl_ciclo_reproductivo}""",
    "fx_movimiento_grande": """
        SELECT id_mov_insumo, id_insumo, tipo_movimiento, destino_venta,
               CAST(CASE WHEN id_insumo % 20 = 3 THEN cantidad * 900000 ELSE cantidad END AS DECIMAL(18,2)) AS cantidad,
               CASE WHEN id_insumo % 40 = 3 THEN precio_unitario * 100 ELSE precio_unitario END AS precio_unitario,
               fecha_movimiento
        FROM {tbl_movimiento_insumo}""",
    "fx_alerta_completa": """
        SELECT id_alerta, modulo, id_animal, tipo, prioridad, fecha_programada, estado, id_usuario_atiende,
               CASE WHEN id_alerta % 3 = 0 THEN NULL ELSE concat('Nota ', CAST(id_alerta % 50 AS VARCHAR(20))) END
                   AS descripcion,
               id_alerta % 2 = 0 AS enviar_correo, id_alerta % 4 = 0 AS correo_enviado,
               id_alerta % 5 = 1 AS notificacion_vista
        FROM {tbl_alerta}""",
    "fx_mortalidad_completa": """
        SELECT id_mortalidad, id_animal, fecha_muerte, id_causa, id_usuario,
               CASE WHEN id_mortalidad % 2 = 0 THEN concat('Obs. ', CAST(id_mortalidad AS VARCHAR(20))) END
                   AS observacion
        FROM {tbl_mortalidad}""",
    "fx_ciclo_completo": """
        SELECT id_ciclo, id_animal, fecha_inicio, tipo_evento, estado_ciclo, fecha_parto_real, resultado_parto,
               CASE WHEN estado_ciclo <> 'Pendiente Palpación 1' THEN fecha_inicio + 40 END AS fecha_palpacion1,
               CASE WHEN estado_ciclo = 'Vacía' THEN 'Vacía' WHEN estado_ciclo <> 'Pendiente Palpación 1'
                    THEN 'Preñada' END AS resultado_palpacion1,
               CASE WHEN estado_ciclo IN ('Preñez Confirmada', 'Parto Exitoso') THEN fecha_inicio + 90 END
                   AS fecha_palpacion2,
               CASE WHEN estado_ciclo IN ('Preñez Confirmada', 'Parto Exitoso') THEN 'Confirmada' END
                   AS resultado_palpacion2
        FROM {tbl_ciclo_reproductivo}""",
    "fx_ciclo_quedan": "SELECT id_ciclo, id_animal FROM {tbl_ciclo_reproductivo} WHERE id_ciclo % 13 <> 0",
    "fx_programacion_despues": """
        SELECT id_programacion, id_registro_san, fecha_programada,
               CASE WHEN estado = 'Pendiente' AND id_programacion % 2 = 0 THEN 'Aplicado'
                    ELSE estado END AS estado
        FROM {tbl_programacion_sanitaria}""",
    "fx_alerta_sanidad": """
        SELECT id_animal * 100000000 + year(fecha_programada) * 10000 + month(fecha_programada) * 100
                   + day(fecha_programada) AS id_alerta,
               CASE WHEN id_animal % 7 = 3 THEN 'General' ELSE 'Sanidad' END AS modulo, id_animal,
               'Próxima dosis' AS tipo, 'Normal' AS prioridad,
               fecha_programada + CAST(CASE WHEN id_animal % 5 = 1 THEN 1 ELSE 0 END AS INT) AS fecha_programada,
               CASE WHEN id_animal % 9 = 0 THEN 'Cancelada' ELSE 'Pendiente' END AS estado
        FROM (SELECT DISTINCT a.id_animal, p.fecha_programada
              FROM {tbl_registro_sanitario_animal} a
              JOIN {tbl_programacion_sanitaria} p ON a.id_registro_san = p.id_registro_san) x""",
    "fx_causa_pedida": """
        SELECT event_id AS seq,
               CASE WHEN event_id % 50 = 49 THEN 'Fiebre'
                    ELSE CASE event_id % 4 WHEN 0 THEN 'Digestivo' WHEN 1 THEN 'Diarrea'
                         WHEN 2 THEN 'DIGESTIVO ' ELSE 'Otros' END END AS principal,
               CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN upper(event_type)
                    WHEN event_id % 6 = 2 THEN concat(event_type, ' ')
                    WHEN event_id % 6 = 3 THEN concat('nation_', CAST(event_id % 30 AS VARCHAR(20)))
                    WHEN event_id % 6 = 4 THEN concat('Síntoma ', CAST(event_id % 90 AS VARCHAR(20)))
                    ELSE concat('SINTOMA ', CAST(event_id % 90 AS VARCHAR(20))) END AS detalle
        FROM {events}""",
    "fx_alta": """
        SELECT c_custkey AS seq,
               CASE WHEN c_custkey % 50 = 7 THEN 'Buey' ELSE CASE c_custkey % 3 WHEN 0 THEN 'Vaca'
                    WHEN 1 THEN 'Toro' ELSE 'Ternero' END END AS tipo,
               CASE WHEN c_custkey % 10 = 0 THEN lower(c_name) ELSE concat('N', c_name) END AS arete,
               CASE WHEN c_custkey % 50 = 9 THEN '12345'
                    WHEN c_custkey % 10 = 1 THEN lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0')
                    ELSE lpad(CAST(c_custkey + 500000 AS VARCHAR(20)), 6, '0') END AS trazabilidad,
               CASE WHEN c_custkey % 30 = 4 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sexo,
               CASE WHEN c_custkey % 60 = 5 THEN 99 ELSE c_nationkey + 1 END AS id_raza,
               c_custkey % 26 + 1 AS id_manga,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 5 + 1 END AS id_procedencia,
               DATE '1998-01-31' + CAST(c_custkey % 90 AS INT) AS fecha_nac,
               CAST(CASE WHEN c_custkey % 75 = 8 THEN 12345.67
                    ELSE (c_custkey * 7919 % 6000 + 2000) / 100.0 END AS DECIMAL(7,2)) AS peso,
               CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Ceba' WHEN 2 THEN 'Trabajo'
                    ELSE 'Levante' END AS proposito,
               CASE WHEN c_custkey % 9 = 2 THEN -5 WHEN c_custkey % 8 = 0 THEN NULL
                    ELSE c_custkey - c_custkey % 3 END AS id_madre,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1 END AS id_padre,
               CASE WHEN c_custkey % 45 = 11 THEN 999999 ELSE c_custkey % 10 END AS id_usuario
        FROM {customer}""",
    "fx_promocion": """
        SELECT c_custkey AS seq,
               CASE WHEN c_custkey % 37 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS id_animal,
               CASE WHEN c_custkey % 4 < 2 THEN 'Vaca' ELSE 'Toro' END AS nuevo_tipo,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Ceba' END AS proposito,
               CASE WHEN c_custkey % 43 = 5 THEN 999999 ELSE c_custkey % 10 END AS id_usuario
        FROM {customer}""",
    "fx_alerta_pedida": """
        SELECT event_id AS seq,
               CASE event_id % 5 WHEN 0 THEN 'Inventario' WHEN 1 THEN 'General' WHEN 2 THEN 'Mortalidad'
                    WHEN 3 THEN 'Otro' ELSE 'Sanidad' END AS modulo,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 2000 END AS id_animal,
               event_type AS tipo, props AS descripcion,
               CASE event_id % 4 WHEN 0 THEN 'Urgente' WHEN 1 THEN 'Normal' WHEN 2 THEN 'Baja'
                    ELSE CASE WHEN event_id % 8 = 3 THEN NULL ELSE 'Normal' END END AS prioridad,
               CAST(ts AS DATE) AS fecha_prog, event_id % 2 = 0 AS enviar_correo,
               CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 10 END AS id_usuario
        FROM {events}""",
    "fx_atencion": """
        SELECT event_id AS seq, event_id - event_id % 3 AS id_alerta,
               CASE WHEN event_id % 29 = 3 THEN 999999 ELSE event_id % 11 END AS id_usuario
        FROM {events}""",
    "fx_sanidad": """
        SELECT o_orderkey AS seq,
               CASE WHEN o_orderkey % 40 = 13 THEN 'Otra' WHEN o_orderkey % 3 = 2 THEN 'Mastitis'
                    ELSE 'Tratamiento' END AS categoria,
               CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'refuerzo' END AS sub_tipo,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Preventivo' END AS proposito,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 210 END AS id_producto,
               CAST((o_orderkey % 3000) / 100.0 AS DECIMAL(8,2)) AS dosis_valor, 'ml' AS dosis_unidad,
               CAST(o_orderdate AS DATE) AS fecha_aplicacion,
               CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'Semanal' END AS repeticion,
               CAST(NULL AS INT) AS intervalo_dias, CAST(NULL AS INT) AS duracion_dias,
               o_orderkey % 25 + 1 AS id_causa, CAST(NULL AS VARCHAR(20)) AS notas,
               o_orderkey % 10 AS id_veterinario, o_orderkey % 10 AS id_usuario,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL
                    ELSE concat('[', CAST(o_custkey AS VARCHAR(20)), ',', CAST(CASE
                         WHEN o_orderkey % 97 = 5 THEN 99999999
                         ELSE (o_custkey + o_orderkey % 3) % (SELECT count(*) FROM {customer}) END
                         AS VARCHAR(20)), ']') END AS animales_json,
               CASE WHEN o_orderkey % 53 = 7 THEN '["1998-07-01","mal"]' WHEN o_orderkey % 4 = 0 THEN NULL
                    WHEN o_orderkey % 4 = 1 THEN '[]'
                    ELSE '["1998-07-01","1998-07-08"]' END AS cronograma_json,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 23 = 4 THEN '{{mal'
                    ELSE concat('[{{"id_animal":', CAST(o_custkey AS VARCHAR(20)), ',"ad":"Sana","pd":"',
                         CASE WHEN o_orderkey % 31 = 2 THEN 'Rota' ELSE 'Leve' END,
                         '","ai":"Sana","pi":"Moderada"}}]') END AS mastitis_json
        FROM {orders}""",
    "fx_sanidad_manga": """
        SELECT n_nationkey AS seq, n_nationkey + 1 AS id_manga,
               CASE WHEN n_nationkey % 9 = 4 THEN 'Otra' ELSE 'Vacunación' END AS categoria,
               CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'aftosa' END AS sub_tipo,
               'Preventivo' AS proposito, n_nationkey AS id_producto,
               CAST(5 AS DECIMAL(8,2)) AS dosis_valor, 'cc' AS dosis_unidad,
               DATE '1998-06-01' AS fecha_aplicacion, 'Única' AS repeticion,
               CAST(NULL AS INT) AS intervalo_dias, CAST(NULL AS INT) AS duracion_dias,
               CAST(NULL AS INT) AS id_causa, CAST(NULL AS VARCHAR(20)) AS notas,
               n_nationkey % 10 AS id_veterinario, n_nationkey % 10 AS id_usuario,
               CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '["1998-07-01"]'
                    ELSE '["1998-07-01","1998-07-08"]' END AS cronograma_json
        FROM {nation}""",
    "fx_venta": """
        SELECT c_custkey AS seq, c_custkey AS id_baja,
               CASE WHEN c_custkey % 130 = 1 THEN NULL
                    ELSE CAST((c_custkey * 977 % 900000 + 100000) / 100.0 AS DECIMAL(12,2)) END AS precio,
               CAST(c_custkey % 1100 / 100.0 AS DECIMAL(5,2)) AS comision_pct,
               CAST(NULL AS VARCHAR(20)) AS notas,
               CASE WHEN c_custkey % 47 = 3 THEN 999999 ELSE c_custkey % 10 END AS id_usuario
        FROM {customer}""",
    "fx_liquidacion": """
        SELECT c_custkey AS seq,
               CASE WHEN c_custkey % 50 = 3 THEN DATE '1980-01-01'
                    ELSE DATE '1995-01-01' + CAST(c_custkey * 13 % 2300 AS INT) END AS fecha_inicio,
               CASE WHEN c_custkey % 50 = 3 THEN DATE '1980-12-31'
                    ELSE DATE '1995-01-01' + CAST(c_custkey * 13 % 2300 + c_custkey * 7 % 700 - 20 AS INT)
                    END AS fecha_fin,
               CAST(CASE WHEN c_custkey % 50 = 4 THEN 99999999.0 ELSE 0.4525 END AS DECIMAL(18,4)) AS precio_litro,
               CAST(c_custkey % 40 * 50 AS DECIMAL(12,2)) AS descuentos,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS comprador,
               CAST(NULL AS VARCHAR(20)) AS notas,
               CASE WHEN c_custkey % 41 = 9 THEN 999999 ELSE c_custkey % 10 END AS id_usuario
        FROM {customer}""",
    "fx_orden_palpacion": """
        SELECT id_ciclo AS seq, id_ciclo, id_ciclo % 7 AS id_usuario,
               fecha_inicio + CASE grupo % 8 WHEN 5 THEN -2 WHEN 6 THEN 30 WHEN 7 THEN 60 ELSE 65 END AS fecha,
               CASE grupo % 3 WHEN 0 THEN 'Preñada' WHEN 1 THEN 'Vacía' ELSE 'Dudosa' END AS resultado,
               CASE WHEN grupo % 11 = 4 THEN 999999999 ELSE id_ciclo % 10 END AS id_veterinario
        FROM (SELECT id_ciclo, fecha_inicio, CAST(floor(id_ciclo / 6.0) AS BIGINT) AS grupo
              FROM {fx_ciclo}) x""",
    "fx_orden_parto": """
        SELECT id_ciclo AS seq, id_ciclo, id_ciclo % 7 AS id_usuario,
               fecha_inicio + CASE grupo % 8 WHEN 5 THEN -2 WHEN 6 THEN 50 ELSE 285 END AS fecha,
               CASE grupo % 3 WHEN 0 THEN 'Exitoso' WHEN 1 THEN 'Abortado' ELSE 'Dudoso' END AS resultado,
               CASE WHEN grupo % 11 = 4 THEN 999999999 ELSE id_ciclo % 10 END AS id_veterinario
        FROM (SELECT id_ciclo, fecha_inicio, CAST(floor(id_ciclo / 6.0) AS BIGINT) AS grupo
              FROM {fx_ciclo}) x""",
    "fx_orden_servicio": """
        SELECT id_ciclo AS seq, id_ciclo, id_ciclo % 7 AS id_usuario,
               fecha_inicio + CASE grupo % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 4000 ELSE -5 END AS fecha,
               CASE grupo % 5 WHEN 0 THEN 'Otro' WHEN 1 THEN 'Monta Natural'
                    ELSE 'Inseminación Artificial' END AS tipo_evento,
               CASE WHEN grupo % 11 = 4 THEN 999999999 ELSE id_ciclo % 10 END AS id_veterinario
        FROM (SELECT id_ciclo, fecha_inicio, CAST(floor(id_ciclo / 6.0) AS BIGINT) AS grupo
              FROM {fx_ciclo}) x""",
    "fx_ciclo_lote": """
        SELECT id_ciclo, id_animal, fecha_inicio, tipo_evento, id_veterinario_inicio, fecha_estimada_palp1,
               fecha_estimada_palp2, fecha_estimada_parto,
               CASE WHEN id_ciclo % 6 < 4 AND id_ciclo % 4 > 0 THEN 'Vacía' ELSE estado_ciclo END AS estado_ciclo,
               fecha_palpacion1, resultado_palpacion1, id_veterinario_palp1, fecha_palpacion2,
               resultado_palpacion2, id_veterinario_palp2, fecha_parto_real, resultado_parto,
               id_veterinario_parto
        FROM {fx_ciclo}""",
    # Only Spark reads this one: the oracle of the replay states its own commands.
    "fx_lote": """
        SELECT id_ciclo * 16 + (id_ciclo * 5 + k * 3) % 16 AS seq, id_ciclo, id_animal, id_ciclo % 7 AS id_usuario,
               CASE k % 8 WHEN 0 THEN 'registrar_palpacion1' WHEN 1 THEN 'editar_servicio'
                    WHEN 2 THEN 'registrar_palpacion2' WHEN 3 THEN 'editar_palpacion1'
                    WHEN 4 THEN 'registrar_parto' WHEN 5 THEN 'editar_palpacion2'
                    WHEN 6 THEN 'editar_parto' ELSE 'iniciar_ciclo' END AS orden,
               fecha_inicio + CASE k % 8 WHEN 0 THEN 31 WHEN 1 THEN CAST(id_ciclo % 3 AS INT)
                    WHEN 2 THEN 62 WHEN 3 THEN 30 + CAST(id_ciclo % 4 AS INT) + k WHEN 4 THEN 280
                    WHEN 5 THEN 60 + CAST(id_ciclo % 5 AS INT) + k WHEN 6 THEN 284 ELSE 300 END AS fecha,
               CASE WHEN k % 8 = 4 OR k % 8 = 6 THEN
                         CASE WHEN (id_ciclo + k) % 3 = 0 THEN 'Abortado' ELSE 'Exitoso' END
                    WHEN (id_ciclo + k) % 5 = 0 THEN 'Vacía' WHEN (id_ciclo + k) % 13 = 0 THEN 'Dudosa'
                    ELSE 'Preñada' END AS resultado,
               CASE WHEN (id_ciclo + k) % 2 = 0 THEN 'Monta Natural' ELSE 'Inseminación Artificial' END
                   AS tipo_evento,
               (id_ciclo + k) % 10 AS id_veterinario
        FROM {fx_ciclo} LATERAL VIEW explode(sequence(0, 15)) ks AS k""",
    "fx_inicio": """
        SELECT c_custkey AS seq, c_custkey AS id_animal,
               CASE WHEN c_custkey % 20 = 3 THEN NULL ELSE DATE '1998-05-01' + CAST(c_custkey % 30 AS INT)
                    END AS fecha_inicio,
               CASE WHEN c_custkey % 2 = 0 THEN 'Monta Natural' ELSE 'Inseminación Artificial' END AS tipo_evento,
               CASE WHEN c_custkey % 11 = 4 THEN 999999999 ELSE c_custkey % 10 END AS id_veterinario
        FROM {customer}""",
}

_NAMES = re.compile(r"\b(?:in_tbl|tbl|fx)_[a-z_0-9]+")


class Tables:
    """Lazy, memoised access to the derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str, run_ts: str):
        self.spark, self.sf_dir, self.as_of, self.run_ts = spark, sf_dir, as_of, run_ts
        self._cache: dict[str, DataFrame] = {}
        self._runs: dict = {}

    def once(self, run, *args) -> dict[str, DataFrame]:
        """The outputs of an operator run, planned once for all of them."""
        if (run, args) not in self._runs:
            self._runs[run, args] = run(self, *args)
        return self._runs[run, args]

    def base(self, name: str) -> DataFrame:
        if name not in self._cache:
            reader = self.spark.read.schema(BASE[name])
            self._cache[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def base_rows(self) -> int:
        """The rows of the source files that grow, counted in one job that reads no column."""
        files = [self.base(name).select() for name in ("customer", "part", "orders", "lineitem", "events")]
        return reduce(DataFrame.union, files).count()

    def sql(self, text: str) -> DataFrame:
        """Run SQL whose ``{name}`` placeholders are source files or derived tables."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: self.base(n) if n in BASE else self[n] for n in names})

    def narrow(self, name: str) -> DataFrame:
        """A derived table with only the columns its rule states."""
        if name in HISTORY_COLUMNS:
            return self._history(name)
        if name == "tbl_programacion_sanitaria":
            return self.sql(
                _SCHEDULE + "FROM {orders} LATERAL VIEW explode(array(1, 2)) ks AS k WHERE o_orderkey % 4 <> 1"
            )
        return self.sql(DERIVED[name])

    def _history(self, name: str) -> DataFrame:
        key, remainder, columns = HISTORY_COLUMNS[name]
        rows = (
            self.base("orders")
            .filter(F.col("o_custkey") % 3 == remainder)
            .selectExpr(f"o_orderkey AS {key}", "o_custkey AS id_animal", f"{_DAY} AS fecha_inicio")
        )
        rows = next_value(rows, ["id_animal"], key, F.col("fecha_inicio"), "sig")
        return rows.selectExpr(
            key, "id_animal", *columns, "fecha_inicio", "sig AS fecha_fin", "sig IS NULL AS es_vigente"
        )

    def intake(self, table: str) -> DataFrame:
        """The columns a table brings, with extra references and planted errors."""
        if f"in_{table}" not in self._cache:
            df = self.narrow(table)
            dirty = DIRTY.get(table, {})
            extra = EXTRA.get(table, {})
            if dirty or extra:
                kept = [f"{dirty[c]} AS {c}" if c in dirty else c for c in df.columns]
                df = df.selectExpr(*kept, *(f"{e} AS {c}" for c, e in extra.items()))
            self._cache[f"in_{table}"] = df
        return self._cache[f"in_{table}"]

    def __getitem__(self, name: str) -> DataFrame:
        """A derived table with its full schema."""
        if name in FIXTURES and name not in self._cache:
            self._cache[name] = self.sql(FIXTURES[name])
        if name not in self._cache:
            table = TABLES[name]
            df = fill_defaults(self.narrow(name), table, self.as_of, self.run_ts)
            self._cache[name] = with_generated(df, table) if table.generated else df
        return self._cache[name]



def _plain(text: str) -> str:
    """The SQL with every placeholder replaced by the name it stands for."""
    return text.format(**{n: n for n in (*BASE, *DERIVED, *FIXTURES)})


def delivered_columns(table: str) -> list[str]:
    """The model columns an intake table really brings."""
    named = set(re.findall(r"\bAS (\w+)", DERIVED[table])) | set(EXTRA.get(table, {}))
    return [c.name for c in TABLES[table].columns if c.name in named]


def with_tables(sql: str) -> str:
    """The oracle form: prepend the derived tables an SQL text names as CTEs."""
    ctes: dict[str, str] = {}

    def add(name: str):
        if name in ctes:
            return
        if name.startswith("in_"):
            table = name[3:]
            add(table)
            dirty = ", ".join(f"{e} AS {c}" for c, e in DIRTY.get(table, {}).items())
            extra = "".join(f", {e} AS {c}" for c, e in EXTRA.get(table, {}).items())
            ctes[name] = f"SELECT * {f'REPLACE ({dirty})' if dirty else ''}{extra} FROM {table}"
        elif name in FIXTURES:
            for used in _NAMES.findall(FIXTURES[name]):
                add(used)
            ctes[name] = _plain(FIXTURES[name])
        else:
            ctes[name] = _plain(DERIVED[name])

    for name in dict.fromkeys(_NAMES.findall(sql)):
        if name.removeprefix("in_") in DERIVED or name in FIXTURES:
            add(name)
    head = ",\n".join(f"{n} AS ({q})" for n, q in ctes.items())
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}" if head else body
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body
