"""The batch command jobs over the derived tables, with their oracle SQL."""

from __future__ import annotations

from ..operators import commands as P
from .settings import AS_OF, AUDITOR, RUN_TS


def _pick(df, columns):
    return df.select(*(c.strip() for c in columns.split(",")))


def _causas(t):
    return P.resolver_causas(t["tbl_causa"], t["fx_causa_pedida"])


def _altas(t):
    return P.alta_animales(t["fx_alta"], t, AS_OF, RUN_TS)


def _promociones(t):
    return P.promover_terneros(t["fx_promocion"], t, AS_OF, RUN_TS)


def _alertas(t):
    return P.crear_alertas(
        t["fx_alerta_pedida"], t["tbl_alerta"], t["tbl_animal"], t["tbl_usuario"], AUDITOR, AS_OF, RUN_TS
    )


def _atenciones(t):
    return P.atender_alertas(t["fx_atencion"], t["tbl_alerta"], t["tbl_usuario"], AUDITOR, RUN_TS)


def _individual(t):
    return P.sanidad_individual(t["fx_sanidad"], t, AUDITOR, AS_OF, RUN_TS)


def _masiva(t):
    return P.sanidad_masiva(t["fx_sanidad_manga"], t, AUDITOR, AS_OF, RUN_TS)


def _ventas(t):
    return P.ingreso_venta_animal(
        t["fx_venta"], t["tbl_baja_animal"], t["tbl_animal"], t["tbl_transaccion_financiera"], t["tbl_usuario"]
    )


def _leche(t):
    return P.liquidar_leche(
        t["fx_liquidacion"], t["tbl_produccion_leche"], t["tbl_transaccion_financiera"], t["tbl_usuario"]
    )


# Operator -> output -> the columns shown.
OUTPUTS = {
    ("resolver_causas", _causas): {
        "resueltas": "seq, id_causa",
        "tbl_causa": "id_causa, causa_principal, detalle_causa",
        "rechazadas": "seq, motivo",
    },
    ("alta_animales", _altas): {
        "tbl_animal": "id_animal, arete, trazabilidad, tipo_animal, sexo, id_raza, id_manga_actual, "
        "id_procedencia, fecha_nacimiento, peso_actual_kg, estado_animal, fecha_ingreso",
        "tbl_vaca_detalle": "id_vaca_detalle, id_animal, estado_ordeno, estado_reproductivo, fecha_inicio, es_vigente",
        "tbl_toro_detalle": "id_toro_detalle, id_animal, tipo_uso, id_usuario_registro, libido_evaluacion",
        "tbl_ternero_detalle": "id_ternero_detalle, id_animal, id_madre, id_padre, peso_nacimiento_kg",
        "tbl_bitacora": "id_usuario, accion, tabla_afectada, id_registro, detalle",
        "rechazadas": "seq, motivo",
    },
    ("promover_terneros", _promociones): {
        "tbl_animal": "id_animal, tipo_animal",
        "tbl_ternero_detalle": "id_ternero_detalle, id_animal, fecha_fin, es_vigente",
        "tbl_vaca_detalle": "id_vaca_detalle, id_animal, fecha_inicio, fecha_fin, es_vigente",
        "tbl_toro_detalle": "id_toro_detalle, id_animal, tipo_uso, fecha_inicio, fecha_fin, es_vigente",
        "tbl_bitacora": "id_usuario, accion, id_registro, detalle",
        "rechazadas": "seq, motivo",
    },
    ("crear_alertas", _alertas): {
        "tbl_alerta": "id_alerta, modulo, id_animal, tipo, descripcion, prioridad, fecha_programada, "
        "estado, enviar_correo, id_usuario_atiende",
        "tbl_auditoria_alerta": "id_alerta, modulo, estado_anterior, estado_nuevo, accion_auditoria",
        "rechazadas": "seq, motivo",
    },
    ("atender_alertas", _atenciones): {
        "tbl_alerta": "id_alerta, estado, fecha_atendida, notificacion_vista, id_usuario_atiende",
        "tbl_auditoria_alerta": "id_alerta, estado_anterior, estado_nuevo, accion_auditoria",
        "rechazadas": "seq, motivo",
    },
    ("sanidad_individual", _individual): {
        "tbl_registro_sanitario": "id_registro_san, tipo_aplicacion, categoria, repeticion, id_producto, dosis_valor",
        "tbl_registro_sanitario_animal": "id_registro_san, id_animal, estado_aplicacion, fecha_real_aplicacion",
        "tbl_programacion_sanitaria": "id_registro_san, fecha_programada, estado",
        "tbl_alerta": "id_alerta, modulo, id_animal, tipo, descripcion, prioridad, fecha_programada, estado",
        "tbl_auditoria_alerta": "id_alerta, id_animal, estado_anterior, estado_nuevo, accion_auditoria",
        "tbl_mastitis_cuartos": "id_registro_san, id_animal, cuarto_ad, cuarto_pd, cuarto_ai, cuarto_pi",
        "rechazadas": "seq, motivo",
    },
    ("sanidad_masiva", _masiva): {
        "tbl_registro_sanitario": "id_registro_san, tipo_aplicacion, categoria, repeticion, id_producto",
        "tbl_registro_sanitario_animal": "id_registro_san, id_animal, estado_aplicacion",
        "tbl_programacion_sanitaria": "id_registro_san, fecha_programada, estado",
        "tbl_alerta": "id_alerta, modulo, id_animal, tipo, descripcion, fecha_programada",
        "resumen": "seq, id_registro_san, afectados",
        "rechazadas": "seq, motivo",
    },
    ("ingreso_venta_animal", _ventas): {
        "tbl_transaccion_financiera": "id_transaccion, categoria, fecha_transaccion, concepto, descripcion, "
        "monto, estado, tipo_origen, id_usuario",
        "tbl_transaccion_animal": "id_transaccion, id_baja, precio_acordado, comision_pct, comision_monto, "
        "neto_recibido",
        "rechazadas": "seq, motivo",
    },
    ("liquidar_leche", _leche): {
        "tbl_transaccion_financiera": "id_transaccion, categoria, fecha_transaccion, concepto, descripcion, "
        "monto, estado, tipo_origen, id_usuario",
        "tbl_transaccion_leche": "id_transaccion, fecha_inicio, fecha_fin, total_litros, precio_litro, "
        "descuentos, ingreso_bruto, ingreso_neto, comprador",
        "rechazadas": "seq, motivo",
    },
}

QUERIES = {
    f"{name}__{output}": lambda t, run=run, output=output, columns=columns: _pick(t.once(run)[output], columns)
    for (name, run), outputs in OUTPUTS.items()
    for output, columns in outputs.items()
}

_NUMBER = "row_number() OVER (ORDER BY seq)"
_REJECTED = "SELECT seq, motivo FROM pedido WHERE motivo IS NOT NULL"

_CAUSES = """
    WITH pedido AS (
        SELECT seq, detalle, CASE rtrim(lower(principal)) WHEN 'digestivo' THEN 'Digestivo'
               WHEN 'diarrea' THEN 'Diarrea' WHEN 'otros' THEN 'Otros' END AS causa,
               strip_accents(lower(rtrim(detalle))) AS k
        FROM fx_causa_pedida),
    pedida AS (
        SELECT causa, k, min(seq) AS seq, min_by(detalle, seq) AS detalle
        FROM pedido WHERE causa IS NOT NULL GROUP BY causa, k),
    hallada AS (
        SELECT p.*, (SELECT min(c.id_causa) FROM tbl_causa c WHERE c.causa_principal = p.causa
               AND strip_accents(lower(rtrim(c.detalle_causa))) IS NOT DISTINCT FROM p.k) AS id
        FROM pedida p),
    clave AS (
        SELECT causa, k, detalle, id IS NULL AS nueva, coalesce(CAST(id AS BIGINT),
               (SELECT max(id_causa) FROM tbl_causa)
               + row_number() OVER (PARTITION BY id IS NULL ORDER BY seq)) AS id_causa
        FROM hallada)
"""

_NEW_ANIMALS = f"""
    WITH pedido AS (
        SELECT p.*, CASE
            WHEN tipo NOT IN ('Vaca', 'Toro', 'Ternero') THEN 'Tipo de animal inválido: use Vaca, Toro o Ternero'
            WHEN sexo IS NULL THEN 'dato obligatorio ausente'
            WHEN length(trazabilidad) <> 6 THEN 'trazabilidad inválida'
            WHEN tipo = 'Toro' AND proposito = 'Trabajo' THEN 'propósito inválido'
            WHEN id_raza > 25 THEN 'raza inexistente'
            WHEN id_manga > 25 THEN 'manga inexistente'
            WHEN tipo = 'Ternero' AND id_madre = -5 THEN 'padre o madre inexistente'
            WHEN id_usuario NOT IN (SELECT id_usuario FROM tbl_usuario) THEN 'usuario inexistente'
            WHEN tipo = 'Ternero' AND peso >= 10000 THEN 'peso fuera de rango'
            WHEN EXISTS (SELECT 1 FROM tbl_animal a WHERE lower(a.arete) = lower(p.arete)) THEN 'arete duplicado'
            WHEN EXISTS (SELECT 1 FROM tbl_animal a WHERE a.trazabilidad = p.trazabilidad)
                THEN 'trazabilidad duplicada' END AS motivo
        FROM fx_alta p),
    alta AS (
        SELECT *, (SELECT max(id_animal) FROM tbl_animal) + {_NUMBER} AS id_animal
        FROM pedido WHERE motivo IS NULL)
"""

_PROMOTED = """
    WITH pedido AS (
        SELECT p.*, CASE WHEN a.id_animal IS NULL THEN 'animal inexistente'
            WHEN (nuevo_tipo = 'Vaca' AND a.sexo <> 'F') OR (nuevo_tipo = 'Toro' AND a.sexo <> 'M')
                THEN 'Sexo del animal incompatible con la promoción solicitada'
            WHEN p.id_usuario NOT IN (SELECT id_usuario FROM tbl_usuario) THEN 'usuario inexistente' END AS motivo
        FROM fx_promocion p LEFT JOIN tbl_animal a ON a.id_animal = p.id_animal),
    sube AS (SELECT * FROM pedido WHERE motivo IS NULL)
"""

_ALERTS = f"""
    WITH pedido AS (
        SELECT p.*, CASE
            WHEN modulo = 'Otro' THEN 'módulo inválido'
            WHEN prioridad IS NULL THEN 'prioridad inválida'
            WHEN id_animal NOT IN (SELECT id_animal FROM tbl_animal) THEN 'animal inexistente' END AS motivo
        FROM fx_alerta_pedida p),
    nueva AS (
        SELECT *, (SELECT max(id_alerta) FROM tbl_alerta) + {_NUMBER} AS id_alerta
        FROM pedido WHERE motivo IS NULL)
"""

_ATTENDED = """
    WITH pedido AS (
        SELECT p.*, CASE WHEN u.id_usuario IS NULL THEN 'usuario inexistente' END AS motivo
        FROM fx_atencion p LEFT JOIN tbl_usuario u ON u.id_usuario = p.id_usuario),
    atiende AS (
        SELECT id_alerta, min_by(id_usuario, seq) AS por FROM pedido WHERE motivo IS NULL GROUP BY id_alerta)
"""

_HEALTH = f"""
    WITH leido AS (
        SELECT *, CAST(json_extract(animales_json, '$[*]') AS BIGINT[]) AS animales,
               list_transform(json_extract_string(cronograma_json, '$[*]'), lambda f: try_cast(f AS DATE)) AS fechas
        FROM fx_sanidad),
    pedido AS (
        SELECT *, CASE WHEN categoria = 'Otra' THEN 'categoría inválida'
            WHEN id_producto IS NOT NULL AND id_producto NOT IN (SELECT id_producto FROM tbl_producto_sanitario)
                THEN 'producto inexistente'
            WHEN list_contains(list_transform(fechas, lambda f: f IS NULL), true) THEN 'cronograma inválido'
            WHEN len(list_distinct(animales)) < len(animales) THEN 'animal repetido'
            WHEN list_contains(animales, 99999999) THEN 'animal inexistente'
            WHEN categoria = 'Mastitis' AND mastitis_json = '{{mal' THEN 'cuartos inválidos'
            WHEN categoria = 'Mastitis' AND mastitis_json LIKE '%Rota%' THEN 'cuarto inválido' END AS motivo
        FROM leido),
    evento AS (
        SELECT *, (SELECT max(id_registro_san) FROM tbl_registro_sanitario) + {_NUMBER} AS id_registro_san
        FROM pedido WHERE motivo IS NULL),
    animal AS (
        SELECT id_registro_san, categoria, sub_tipo, fechas, u.i, animales[u.i] AS id_animal
        FROM evento, LATERAL (SELECT unnest(range(1, len(animales) + 1)) AS i) u),
    alerta AS (
        SELECT (SELECT max(id_alerta) FROM tbl_alerta) + row_number() OVER (ORDER BY id_registro_san, i, f.j)
                   AS id_alerta, id_animal, categoria, sub_tipo, fechas[f.j] AS fecha_programada
        FROM animal, LATERAL (SELECT unnest(range(1, len(fechas) + 1)) AS j) f)
"""

_HERD_HEALTH = f"""
    WITH leido AS (
        SELECT *, CAST(json_extract_string(cronograma_json, '$[*]') AS DATE[]) AS fechas,
               (SELECT count(*) FROM tbl_animal a WHERE a.id_manga_actual = p.id_manga
                AND a.estado_animal = 'Activo') AS afectados
        FROM fx_sanidad_manga p),
    pedido AS (
        SELECT *, CASE WHEN afectados = 0
                THEN 'La manga seleccionada está vacía o no tiene animales activos.'
            WHEN categoria = 'Otra' THEN 'categoría inválida' END AS motivo
        FROM leido),
    evento AS (
        SELECT *, (SELECT max(id_registro_san) FROM tbl_registro_sanitario) + {_NUMBER} AS id_registro_san
        FROM pedido WHERE motivo IS NULL),
    animal AS (
        SELECT e.*, a.id_animal FROM evento e JOIN tbl_animal a
          ON a.id_manga_actual = e.id_manga AND a.estado_animal = 'Activo'),
    alerta AS (
        SELECT (SELECT max(id_alerta) FROM tbl_alerta) + row_number() OVER (ORDER BY seq, id_animal, f.j)
                   AS id_alerta, id_animal, categoria, sub_tipo, fechas[f.j] AS fecha_programada
        FROM animal, LATERAL (SELECT unnest(range(1, len(fechas) + 1)) AS j) f)
"""

_SALES = f"""
    WITH pedido AS (
        SELECT p.*, b.fecha_baja, b.comprador, a.arete, CASE WHEN a.arete IS NULL THEN 'baja inexistente'
            WHEN p.precio IS NULL THEN 'precio inválido'
            WHEN p.id_usuario NOT IN (SELECT id_usuario FROM tbl_usuario) THEN 'usuario inexistente' END AS motivo
        FROM fx_venta p LEFT JOIN tbl_baja_animal b ON b.id_baja = p.id_baja
        LEFT JOIN tbl_animal a ON a.id_animal = b.id_animal),
    venta AS (
        SELECT *, (SELECT max(id_transaccion) FROM tbl_transaccion_financiera) + {_NUMBER} AS id_transaccion
        FROM pedido WHERE motivo IS NULL)
"""

_MILK = f"""
    WITH total AS (
        SELECT p.seq, CAST(coalesce(sum(l.litros_manana + l.litros_tarde), 0) AS DECIMAL(10,2)) AS total_litros
        FROM fx_liquidacion p LEFT JOIN tbl_produccion_leche l
          ON l.fecha_ordeno BETWEEN p.fecha_inicio AND p.fecha_fin GROUP BY p.seq),
    neto AS (
        SELECT p.*, t.total_litros, CAST(t.total_litros AS DECIMAL(20,2)) * p.precio_litro AS bruto,
               TRY_CAST(CAST(t.total_litros AS DECIMAL(20,2)) * p.precio_litro - p.descuentos AS DECIMAL(12,2)) AS neto
        FROM fx_liquidacion p JOIN total t ON t.seq = p.seq),
    pedido AS (
        SELECT *, CASE WHEN total_litros = 0 THEN 'No hay registros de producción en el período indicado'
            WHEN neto IS NULL OR round(bruto, 2) >= 10000000000 THEN 'importe fuera de rango'
            WHEN neto < 0 THEN 'ingreso neto negativo'
            WHEN id_usuario NOT IN (SELECT id_usuario FROM tbl_usuario) THEN 'usuario inexistente' END AS motivo
        FROM neto),
    pago AS (
        SELECT *, (SELECT max(id_transaccion) FROM tbl_transaccion_financiera) + {_NUMBER} AS id_transaccion
        FROM pedido WHERE motivo IS NULL)
"""


def _detail_id(kind):
    return f"(SELECT max(id_{kind}_detalle) FROM tbl_{kind}_detalle) + {_NUMBER} AS id_{kind}_detalle"


def _closed_history(kind, column, kept, new):
    """Existing detail rows with the open ones closed by a new current row, and the new rows."""
    return (
        _PROMOTED
        + f"""
    SELECT id_{kind}_detalle, d.id_animal, {column} fecha_inicio,
           CASE WHEN es_vigente AND s.id_animal IS NOT NULL THEN DATE '{AS_OF}' ELSE fecha_fin END AS fecha_fin,
           es_vigente AND s.id_animal IS NULL AS es_vigente
    FROM tbl_{kind}_detalle d LEFT JOIN (SELECT * FROM sube WHERE {kept}) s ON s.id_animal = d.id_animal
    UNION ALL
    SELECT {_detail_id(kind)}, id_animal, {new} DATE '{AS_OF}', NULL, true FROM sube WHERE {kept}"""
    )


ORACLE = {
    "resolver_causas__resueltas": _CAUSES
    + """SELECT p.seq, c.id_causa FROM pedido p JOIN clave c
         ON c.causa = p.causa AND c.k IS NOT DISTINCT FROM p.k""",
    "resolver_causas__tbl_causa": _CAUSES
    + "SELECT id_causa, causa AS causa_principal, detalle AS detalle_causa FROM clave WHERE nueva",
    "resolver_causas__rechazadas": _CAUSES
    + "SELECT seq, 'causa principal fuera de dominio' AS motivo FROM pedido WHERE causa IS NULL",
    "alta_animales__tbl_animal": _NEW_ANIMALS
    + f"""SELECT id_animal, arete, trazabilidad, tipo AS tipo_animal, sexo, id_raza,
           id_manga AS id_manga_actual, id_procedencia, fecha_nac AS fecha_nacimiento,
           peso AS peso_actual_kg, 'Activo' AS estado_animal, DATE '{AS_OF}' AS fecha_ingreso FROM alta""",
    "alta_animales__tbl_vaca_detalle": _NEW_ANIMALS
    + f"""SELECT {_detail_id('vaca')}, id_animal, 'Activo' AS estado_ordeno, 'Vacía' AS estado_reproductivo,
           DATE '{AS_OF}' AS fecha_inicio, true AS es_vigente FROM alta WHERE tipo = 'Vaca'""",
    "alta_animales__tbl_toro_detalle": _NEW_ANIMALS
    + f"""SELECT {_detail_id('toro')}, id_animal, coalesce(proposito, 'Semental') AS tipo_uso,
           id_usuario AS id_usuario_registro, 'Sin evaluar' AS libido_evaluacion
           FROM alta WHERE tipo = 'Toro'""",
    "alta_animales__tbl_ternero_detalle": _NEW_ANIMALS
    + f"""SELECT {_detail_id('ternero')}, id_animal, id_madre, id_padre,
           CAST(peso AS DECIMAL(6,2)) AS peso_nacimiento_kg FROM alta WHERE tipo = 'Ternero'""",
    "alta_animales__tbl_bitacora": _NEW_ANIMALS
    + """SELECT id_usuario, 'INSERT' AS accion, 'tbl_animal' AS tabla_afectada,
           CAST(id_animal AS VARCHAR) AS id_registro,
           '{"tipo":"' || tipo || '","arete":"' || arete || '"}' AS detalle FROM alta""",
    "alta_animales__rechazadas": _NEW_ANIMALS + _REJECTED,
    "promover_terneros__tbl_animal": _PROMOTED
    + """SELECT a.id_animal, coalesce(s.nuevo_tipo, a.tipo_animal) AS tipo_animal
         FROM tbl_animal a LEFT JOIN sube s ON s.id_animal = a.id_animal""",
    "promover_terneros__tbl_ternero_detalle": _PROMOTED
    + f"""SELECT id_ternero_detalle, d.id_animal,
           CASE WHEN es_vigente AND s.id_animal IS NOT NULL THEN DATE '{AS_OF}' ELSE fecha_fin END AS fecha_fin,
           es_vigente AND s.id_animal IS NULL AS es_vigente
         FROM tbl_ternero_detalle d LEFT JOIN sube s ON s.id_animal = d.id_animal""",
    "promover_terneros__tbl_vaca_detalle": _closed_history("vaca", "", "nuevo_tipo = 'Vaca'", ""),
    "promover_terneros__tbl_toro_detalle": _closed_history(
        "toro", "tipo_uso,", "nuevo_tipo = 'Toro'", "coalesce(proposito, 'Semental'),"
    ),
    "promover_terneros__tbl_bitacora": _PROMOTED
    + """SELECT id_usuario, 'PROMOTE' AS accion, CAST(id_animal AS VARCHAR) AS id_registro,
           '{"nuevo_tipo":"' || nuevo_tipo || '"}' AS detalle FROM sube""",
    "promover_terneros__rechazadas": _PROMOTED + _REJECTED,
    "crear_alertas__tbl_alerta": _ALERTS
    + """SELECT id_alerta, modulo, id_animal, tipo, descripcion, prioridad, fecha_prog AS fecha_programada,
           'Pendiente' AS estado, enviar_correo, id_usuario AS id_usuario_atiende FROM nueva""",
    "crear_alertas__tbl_auditoria_alerta": _ALERTS
    + """SELECT id_alerta, modulo, 'N/A' AS estado_anterior, 'Pendiente' AS estado_nuevo,
           'Creada' AS accion_auditoria FROM nueva""",
    "crear_alertas__rechazadas": _ALERTS + _REJECTED,
    "atender_alertas__tbl_alerta": _ATTENDED
    + f"""SELECT a.id_alerta, CASE WHEN cierra THEN 'Atendida' ELSE estado END AS estado,
           CASE WHEN cierra THEN TIMESTAMP '{RUN_TS}' END AS fecha_atendida,
           coalesce(cierra, false) AS notificacion_vista,
           CASE WHEN cierra THEN por ELSE id_usuario_atiende END AS id_usuario_atiende
         FROM (SELECT a.*, t.por, t.id_alerta IS NOT NULL AND a.estado = 'Pendiente' AS cierra
               FROM tbl_alerta a LEFT JOIN atiende t ON t.id_alerta = a.id_alerta) a""",
    "atender_alertas__tbl_auditoria_alerta": _ATTENDED
    + """SELECT a.id_alerta, 'Pendiente' AS estado_anterior, 'Atendida' AS estado_nuevo,
           'Atendida' AS accion_auditoria
         FROM tbl_alerta a JOIN atiende t ON t.id_alerta = a.id_alerta WHERE a.estado = 'Pendiente'""",
    "atender_alertas__rechazadas": _ATTENDED + _REJECTED,
    "sanidad_individual__tbl_registro_sanitario": _HEALTH
    + """SELECT id_registro_san, 'Individual' AS tipo_aplicacion, categoria,
           coalesce(repeticion, 'Única') AS repeticion, id_producto, dosis_valor FROM evento""",
    "sanidad_individual__tbl_registro_sanitario_animal": _HEALTH
    + f"""SELECT id_registro_san, id_animal, 'Aplicado' AS estado_aplicacion,
           TIMESTAMP '{RUN_TS}' AS fecha_real_aplicacion FROM animal""",
    "sanidad_individual__tbl_programacion_sanitaria": _HEALTH
    + """SELECT id_registro_san, CAST(unnest(fechas) AS TIMESTAMP) AS fecha_programada,
           'Pendiente' AS estado FROM evento""",
    "sanidad_individual__tbl_alerta": _HEALTH
    + """SELECT id_alerta, 'Sanidad' AS modulo, id_animal, 'Próxima dosis: ' || categoria AS tipo,
           'Requiere aplicación programada de ' || coalesce(sub_tipo, 'tratamiento') AS descripcion,
           'Normal' AS prioridad, fecha_programada, 'Pendiente' AS estado FROM alerta""",
    "sanidad_individual__tbl_auditoria_alerta": _HEALTH
    + """SELECT id_alerta, id_animal, 'N/A' AS estado_anterior, 'Pendiente' AS estado_nuevo,
           'Creada' AS accion_auditoria FROM alerta""",
    "sanidad_individual__tbl_mastitis_cuartos": _HEALTH
    + """SELECT id_registro_san, CAST(json_extract(mastitis_json, '$[0].id_animal') AS BIGINT) AS id_animal,
           'Sana' AS cuarto_ad, json_extract_string(mastitis_json, '$[0].pd') AS cuarto_pd,
           'Sana' AS cuarto_ai, 'Moderada' AS cuarto_pi
         FROM evento WHERE categoria = 'Mastitis' AND mastitis_json IS NOT NULL""",
    "sanidad_individual__rechazadas": _HEALTH + _REJECTED,
    "sanidad_masiva__tbl_registro_sanitario": _HERD_HEALTH
    + """SELECT id_registro_san, 'Masivo' AS tipo_aplicacion, categoria, repeticion, id_producto FROM evento""",
    "sanidad_masiva__tbl_registro_sanitario_animal": _HERD_HEALTH
    + "SELECT id_registro_san, id_animal, 'Aplicado' AS estado_aplicacion FROM animal",
    "sanidad_masiva__tbl_programacion_sanitaria": _HERD_HEALTH
    + """SELECT id_registro_san, CAST(unnest(fechas) AS TIMESTAMP) AS fecha_programada,
           'Pendiente' AS estado FROM evento""",
    "sanidad_masiva__tbl_alerta": _HERD_HEALTH
    + """SELECT id_alerta, 'Sanidad' AS modulo, id_animal, 'Próxima dosis: ' || categoria AS tipo,
           'Aplicación masiva programada de ' || coalesce(sub_tipo, 'tratamiento') AS descripcion,
           fecha_programada FROM alerta""",
    "sanidad_masiva__resumen": _HERD_HEALTH + "SELECT seq, id_registro_san, afectados FROM evento",
    "sanidad_masiva__rechazadas": _HERD_HEALTH + _REJECTED,
    "ingreso_venta_animal__tbl_transaccion_financiera": _SALES
    + """SELECT id_transaccion, 'ingreso' AS categoria, fecha_baja AS fecha_transaccion,
           'Venta animal: ' || arete AS concepto, 'Comprador: ' || coalesce(comprador, 'N/A') AS descripcion,
           precio AS monto, 'ejecutado' AS estado, 'Venta Animal' AS tipo_origen, id_usuario FROM venta""",
    "ingreso_venta_animal__tbl_transaccion_animal": _SALES
    + """SELECT id_transaccion, id_baja, precio AS precio_acordado, comision_pct,
           CAST(CAST(precio * comision_pct AS DECIMAL(18,4)) * 0.01 AS DECIMAL(12,2)) AS comision_monto,
           CAST(precio - CAST(precio * comision_pct AS DECIMAL(18,4)) * 0.01 AS DECIMAL(12,2)) AS neto_recibido
         FROM venta""",
    "ingreso_venta_animal__rechazadas": _SALES + _REJECTED,
    "liquidar_leche__tbl_transaccion_financiera": _MILK
    + """SELECT id_transaccion, 'ingreso' AS categoria, fecha_fin AS fecha_transaccion,
           'Liquidación leche: ' || CAST(fecha_inicio AS VARCHAR) || ' → ' || CAST(fecha_fin AS VARCHAR) AS concepto,
           CAST(total_litros AS VARCHAR) || ' lts × $' || CAST(precio_litro AS VARCHAR) || ' | Comprador: '
               || coalesce(comprador, 'N/A') AS descripcion,
           neto AS monto, 'ejecutado' AS estado, 'Ingreso Leche' AS tipo_origen, id_usuario FROM pago""",
    "liquidar_leche__tbl_transaccion_leche": _MILK
    + """SELECT id_transaccion, fecha_inicio, fecha_fin, total_litros, precio_litro, descuentos,
           CAST(bruto AS DECIMAL(12,2)) AS ingreso_bruto, neto AS ingreso_neto,
           comprador FROM pago""",
    "liquidar_leche__rechazadas": _MILK + _REJECTED,
}
