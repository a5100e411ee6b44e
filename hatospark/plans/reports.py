"""The read queries over the derived tables, with their oracle SQL."""

from __future__ import annotations

from ..operators import reports as R
from .settings import AS_OF

QUERIES = {
    "animal_completo": lambda t: R.animal_completo(
        t["tbl_animal"],
        t["tbl_raza"],
        t["tbl_manga"],
        t["tbl_procedencia"],
        t["tbl_vaca_detalle"],
        t["tbl_toro_detalle"],
        t["tbl_ternero_detalle"],
        AS_OF,
    ),
    "inventario_mangas": lambda t: R.inventario_mangas(t["tbl_manga"], t["tbl_animal"]),
    "produccion_reciente": lambda t: R.produccion_reciente(
        t["tbl_produccion_leche"], t["tbl_animal"], t["tbl_raza"], t["tbl_manga"], AS_OF
    ),
    "alertas_pendientes": lambda t: R.alertas_pendientes(
        t["fx_alerta_completa"], t["tbl_animal"], t["tbl_usuario"]
    ),
    "mortalidad": lambda t: R.mortalidad(
        t["fx_mortalidad_completa"], t["tbl_animal"], t["tbl_raza"], t["tbl_causa"], t["tbl_usuario"]
    ),
    "stock_bajo": lambda t: R.stock_bajo(t["tbl_insumo"]),
    "auditoria_alertas": lambda t: R.auditoria_alertas(t["tbl_auditoria_alerta"], t["tbl_animal"]),
    "resumen_financiero_mensual": lambda t: R.resumen_financiero_mensual(
        t["tbl_transaccion_financiera"]
    ),
    "expediente_sanitario": lambda t: R.expediente_sanitario(
        t["tbl_registro_sanitario_animal"],
        t["tbl_registro_sanitario"],
        t["tbl_animal"],
        t["tbl_producto_sanitario"],
        t["tbl_causa"],
        t["tbl_colaborador"],
        t["tbl_programacion_sanitaria"],
    ),
    "kpi_reproductivo": lambda t: R.kpi_reproductivo(t["tbl_ciclo_reproductivo"], AS_OF),
    "proximos_eventos": lambda t: R.proximos_eventos(
        t["tbl_alerta_reproductiva"], t["tbl_animal"], AS_OF
    ),
    "historial_reproductivo": lambda t: R.historial_reproductivo(
        t["fx_ciclo_completo"], t["tbl_animal"]
    ),
}

# Each result is stated on its own terms: lookups of unique keys as scalar subqueries, counts and sums
# in grouped relations, and matched and unmatched rows apart.
ORACLE = {
    "animal_completo": f"""
        WITH vaca AS (SELECT id_animal, estado_ordeno, estado_reproductivo FROM tbl_vaca_detalle WHERE es_vigente),
        toro AS (
            SELECT id_animal, tipo_uso, activo_reproduccion, libido_evaluacion
            FROM tbl_toro_detalle WHERE es_vigente),
        ternero AS (
            SELECT id_animal, estado_lactancia, peso_nacimiento_kg, peso_destete_kg
            FROM tbl_ternero_detalle WHERE es_vigente),
        vida AS (
            SELECT id_animal, 12 * (1998 - year(fecha_nacimiento)) + 6 - month(fecha_nacimiento)
                   - CASE WHEN day(fecha_nacimiento) > 1 THEN 1 ELSE 0 END AS meses
            FROM tbl_animal)
        SELECT id_animal, arete, trazabilidad, tipo_animal, sexo,
               (SELECT nombre_raza FROM tbl_raza x WHERE x.id_raza = a.id_raza) AS nombre_raza,
               (SELECT proposito FROM tbl_raza x WHERE x.id_raza = a.id_raza) AS proposito_raza,
               (SELECT nombre FROM tbl_manga x WHERE x.id_manga = a.id_manga_actual) AS manga_actual,
               (SELECT numero_manga FROM tbl_manga x WHERE x.id_manga = a.id_manga_actual) AS numero_manga,
               (SELECT nombre FROM tbl_procedencia x WHERE x.id_procedencia = a.id_procedencia) AS procedencia,
               fecha_nacimiento, CAST(meses AS BIGINT) AS edad_meses, peso_actual_kg, estado_animal,
               estado_ordeno, estado_reproductivo, tipo_uso, activo_reproduccion, libido_evaluacion,
               estado_lactancia, peso_nacimiento_kg, peso_destete_kg
        FROM tbl_animal a JOIN vida USING (id_animal) NATURAL LEFT JOIN vaca NATURAL LEFT JOIN toro
             NATURAL LEFT JOIN ternero""",
    "inventario_mangas": """
        WITH vivos AS (
            SELECT id_manga_actual AS id_manga, count(*) AS n FROM tbl_animal
            WHERE estado_animal <> 'Fallecido' AND estado_animal <> 'Vendido' GROUP BY id_manga_actual),
        cuenta AS (
            SELECT id_manga, n FROM vivos
            UNION ALL
            SELECT id_manga, 0 FROM tbl_manga WHERE id_manga NOT IN (
                SELECT id_manga FROM vivos WHERE id_manga IS NOT NULL))
        SELECT id_manga, numero_manga, nombre, funcion, capacidad_max, CAST(n AS BIGINT) AS cantidad_actual,
               CASE WHEN capacidad_max > 0 THEN CAST(round(n * 100.0 / capacidad_max, 1) AS DOUBLE) END
                   AS pct_ocupacion
        FROM tbl_manga JOIN cuenta USING (id_manga)""",
    "produccion_reciente": f"""
        WITH mes AS (
            SELECT * FROM tbl_produccion_leche WHERE datediff('day', fecha_ordeno, DATE '{AS_OF}') <= 30)
        SELECT id_animal, arete, nombre_raza,
               (SELECT nombre FROM tbl_manga x WHERE x.id_manga = a.id_manga_actual) AS manga,
               fecha_ordeno, litros_manana, litros_tarde,
               CAST(litros_tarde + litros_manana AS DECIMAL(6,2)) AS total_litros
        FROM tbl_raza JOIN tbl_animal a USING (id_raza) JOIN mes USING (id_animal)""",
    "alertas_pendientes": """
        SELECT id_alerta, modulo, tipo, descripcion, prioridad, fecha_programada, enviar_correo,
               correo_enviado, notificacion_vista,
               (SELECT arete FROM tbl_animal x WHERE x.id_animal = p.id_animal) AS arete_animal,
               (SELECT tipo_animal FROM tbl_animal x WHERE x.id_animal = p.id_animal) AS tipo_animal,
               (SELECT estado_animal FROM tbl_animal x WHERE x.id_animal = p.id_animal) AS estado_animal,
               (SELECT nombre_completo FROM tbl_usuario x WHERE x.id_usuario = p.id_usuario_atiende)
                   AS usuario_asignado
        FROM fx_alerta_completa p WHERE estado IN ('Pendiente')""",
    "mortalidad": """
        WITH especie AS (SELECT id_animal, arete, tipo_animal, nombre_raza FROM tbl_raza JOIN tbl_animal USING (id_raza))
        SELECT id_mortalidad, arete, tipo_animal, nombre_raza, fecha_muerte, causa_principal, detalle_causa,
               observacion, (SELECT nombre_completo FROM tbl_usuario x WHERE x.id_usuario = d.id_usuario)
                   AS registrado_por
        FROM fx_mortalidad_completa d JOIN especie USING (id_animal) JOIN tbl_causa USING (id_causa)""",
    "stock_bajo": """
        WITH margen AS (
            SELECT *, CAST(stock_actual - stock_minimo AS DECIMAL(11,2)) AS diferencia FROM tbl_insumo)
        SELECT id_insumo, nombre, unidad, stock_actual, stock_minimo, diferencia
        FROM margen WHERE diferencia <= 0 AND activo IS TRUE""",
    "auditoria_alertas": """
        SELECT * EXCLUDE (id_animal),
               (SELECT arete FROM tbl_animal x WHERE x.id_animal = l.id_animal) AS arete_animal
        FROM (SELECT id_auditoria, id_alerta, modulo, tipo, prioridad, fecha_programada, estado_anterior,
                     estado_nuevo, accion_auditoria, fecha_auditoria, usuario_auditor, id_animal
              FROM tbl_auditoria_alerta) l""",
    "resumen_financiero_mensual": """
        WITH signo AS (
            SELECT date_trunc('month', fecha_transaccion) AS inicio, categoria,
                   CASE categoria WHEN 'gasto' THEN -1 WHEN 'ingreso' THEN 1 ELSE 0 END * monto AS efecto
            FROM tbl_transaccion_financiera)
        SELECT year(inicio) AS anio, month(inicio) AS mes,
               CAST(sum(CASE WHEN categoria = 'ingreso' THEN efecto ELSE 0 END) AS DECIMAL(38,2)) AS total_ingresos,
               CAST(-sum(CASE WHEN categoria = 'gasto' THEN efecto ELSE 0 END) AS DECIMAL(38,2)) AS total_gastos,
               CAST(sum(efecto) AS DECIMAL(38,2)) AS balance
        FROM signo GROUP BY inicio""",
    "expediente_sanitario": """
        WITH pendiente AS (
            SELECT id_registro_san, fecha_programada FROM tbl_programacion_sanitaria WHERE estado = 'Pendiente'),
        proxima AS (
            SELECT id_registro_san, fecha_programada FROM pendiente
            UNION ALL
            SELECT id_registro_san, NULL FROM tbl_registro_sanitario
            WHERE id_registro_san NOT IN (SELECT id_registro_san FROM pendiente)),
        evento AS (
            SELECT id_registro_san, fecha_aplicacion, categoria AS tipo_registro, dosis_valor, dosis_unidad,
                   (SELECT nombre FROM tbl_colaborador x WHERE x.id_colaborador = r.id_veterinario)
                       AS veterinario_responsable,
                   concat(coalesce((SELECT coalesce(detalle_causa, causa_principal) FROM tbl_causa x
                                    WHERE x.id_causa = r.id_causa), 'Sin diagnóstico'), ' — ',
                          coalesce((SELECT nombre FROM tbl_producto_sanitario x
                                    WHERE x.id_producto = r.id_producto), 'Sin producto')) AS detalle_tratamiento
            FROM tbl_registro_sanitario r)
        SELECT id_animal, arete, fecha_aplicacion, tipo_registro, detalle_tratamiento,
               CAST(dosis_valor AS VARCHAR) || ' ' || dosis_unidad AS dosis_aplicada, veterinario_responsable,
               fecha_programada AS proxima_dosis_revision, id_registro_san, estado_aplicacion
        FROM evento JOIN proxima USING (id_registro_san) JOIN tbl_registro_sanitario_animal USING (id_registro_san)
             JOIN (SELECT id_animal, arete FROM tbl_animal) USING (id_animal)""",
    "kpi_reproductivo": f"""
        WITH fase AS (SELECT estado_ciclo, count(*) AS n FROM tbl_ciclo_reproductivo GROUP BY estado_ciclo),
        partos AS (
            SELECT count(*) AS n FROM tbl_ciclo_reproductivo
            WHERE date_trunc('month', fecha_parto_real) = date_trunc('month', DATE '{AS_OF}')
              AND (resultado_parto = 'Exitoso' OR resultado_parto = 'Abortado'))
        SELECT CAST(coalesce((SELECT sum(n) FROM fase WHERE estado_ciclo LIKE 'Preñez %'), 0) AS BIGINT)
                   AS vacas_prenadas,
               (SELECT n FROM partos) AS partos_del_mes,
               CAST((SELECT round(sum(CASE estado_ciclo WHEN 'Parto Exitoso' THEN n ELSE 0 END) * 100.0 / sum(n), 2)
                     FROM fase) AS DOUBLE) AS tasa_exito_pct""",
    "proximos_eventos": f"""
        SELECT id_alerta, arete, tipo_alerta, fecha_programada, 'Pendiente' AS estado_alerta,
               CAST(datediff('day', DATE '{AS_OF}', fecha_programada) AS BIGINT) AS dias_restantes
        FROM tbl_animal JOIN (SELECT * FROM tbl_alerta_reproductiva WHERE estado_alerta = 'Pendiente')
             USING (id_animal)""",
    "historial_reproductivo": """
        SELECT id_ciclo, (SELECT arete FROM tbl_animal x WHERE x.id_animal = c.id_animal) AS arete, fecha_inicio,
               tipo_evento, estado_ciclo, fecha_palpacion1, resultado_palpacion1, fecha_palpacion2,
               resultado_palpacion2, fecha_parto_real, resultado_parto
        FROM fx_ciclo_completo c WHERE id_animal IN (SELECT id_animal FROM tbl_animal)""",
}
