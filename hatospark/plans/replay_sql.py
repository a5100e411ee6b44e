"""Oracle of the replay of mixed batches: the commands of a cycle one after the other.

A recursive relation takes every cycle through its commands by rank, one command a step.  What the
accepted steps do to alerts, cows and the log is then read from the steps.
"""

from __future__ import annotations

from .settings import AS_OF

# Stored reasons and texts.
_STATE = {
    "editar_servicio": "Solo se puede editar el servicio si el ciclo está en Pendiente Palpación 1.",
    "registrar_palpacion1": 'El ciclo debe estar en "Pendiente Palpación 1" para realizar esta acción.',
    "editar_palpacion1": "Solo se puede editar Palpación 1 si el ciclo está en Preñez Provisional.",
    "registrar_palpacion2": 'El ciclo debe estar en "Preñez Provisional" para registrar Palpación 2.',
    "editar_palpacion2": "Solo se puede editar Palpación 2 si el ciclo está en Preñez Confirmada.",
    "registrar_parto": 'El ciclo debe estar en "Preñez Confirmada" para registrar un parto.',
    "editar_parto": "Solo se edita el parto si el ciclo ya finalizó.",
}
_CHECK = """Resultado inválido. Utilice "Preñada" o "Vacía"."""
_BIRTH = """Resultado inválido. Utilice "Exitoso" o "Abortado"."""
_MOVED = "Se recalcularon las fechas estimadas de palpación y parto, y se reprogramó la alerta de Palpación 1."
_REDATED = "Se reprogramó la alerta de Palpación 2 basada en la nueva fecha de Palpación 1."
_EMPTY_1 = (
    "Cambio de estado a Vacía. Se cancelaron alertas futuras y se creó Seguimiento de Celo. "
    "Vaca marcada como Vacía."
)
_EMPTY_2 = "Cambio de estado a Vacía. Se canceló alerta Parto Estimado y creó Seguimiento de Celo."
_ABORTED = "Cambio a Abortado. Requiere eliminar cría manualmente. Generada alerta de Celo."
_BORN = "Cambio a Exitoso. Alerta de Celo cancelada. Ejecutar registro de cría manualmente."
_BUSY = "La vaca ya tiene un ciclo reproductivo activo."

_KEPT = (
    "fecha_inicio", "tipo_evento", "id_veterinario_inicio", "fecha_estimada_palp1", "fecha_estimada_palp2",
    "fecha_estimada_parto", "estado_ciclo", "fecha_palpacion1", "resultado_palpacion1", "id_veterinario_palp1",
    "fecha_palpacion2", "resultado_palpacion2", "id_veterinario_palp2", "fecha_parto_real", "resultado_parto",
    "id_veterinario_parto",
)
_BEFORE = ("estado_ciclo", "fecha_inicio", "tipo_evento", "fecha_palpacion1", "resultado_palpacion1",
           "fecha_palpacion2", "resultado_parto")
_ORDER = ("seq", "orden", "o_fecha", "o_resultado", "o_tipo", "o_vet", "o_usuario")

# What a command does to the cycle, given that it was accepted: verb -> new values.
_SET = {
    "servicio": {
        "fecha_inicio": "o_fecha", "tipo_evento": "o_tipo", "id_veterinario_inicio": "o_vet",
        "fecha_estimada_palp1": "o_fecha + 30", "fecha_estimada_palp2": "o_fecha + 60",
        "fecha_estimada_parto": "o_fecha + 283",
    },
    "palpa1": {
        "fecha_palpacion1": "o_fecha", "resultado_palpacion1": "o_resultado", "id_veterinario_palp1": "o_vet",
        "estado_ciclo": "CASE o_resultado WHEN 'Vacía' THEN 'Vacía' ELSE 'Preñez Provisional' END",
    },
    "palpa2": {
        "fecha_palpacion2": "o_fecha", "resultado_palpacion2": "o_resultado", "id_veterinario_palp2": "o_vet",
        "estado_ciclo": "CASE o_resultado WHEN 'Vacía' THEN 'Vacía' ELSE 'Preñez Confirmada' END",
    },
    "parto": {
        "fecha_parto_real": "o_fecha", "resultado_parto": "o_resultado", "id_veterinario_parto": "o_vet",
        "estado_ciclo": "CASE o_resultado WHEN 'Exitoso' THEN 'Parto Exitoso' ELSE 'Abortado' END",
    },
    "vacia1": {
        "fecha_palpacion1": "o_fecha", "resultado_palpacion1": "'Vacía'", "id_veterinario_palp1": "o_vet",
        "estado_ciclo": "'Vacía'",
    },
    "fecha1": {
        "fecha_palpacion1": "o_fecha", "id_veterinario_palp1": "o_vet", "fecha_estimada_palp2": "o_fecha + 30",
    },
    "veterinario1": {"id_veterinario_palp1": "o_vet"},
    "vacia2": {"fecha_palpacion2": "o_fecha", "resultado_palpacion2": "'Vacía'", "estado_ciclo": "'Vacía'"},
    "fecha2": {"fecha_palpacion2": "o_fecha"},
    "aborta": {"resultado_parto": "'Abortado'", "estado_ciclo": "'Abortado'"},
    "nace": {"resultado_parto": "'Exitoso'", "estado_ciclo": "'Parto Exitoso'"},
}


def _new(column: str) -> str:
    whens = " ".join(f"WHEN '{verb}' THEN {new[column]}" for verb, new in _SET.items() if column in new)
    return f"CASE verbo {whens} ELSE {column} END AS {column}" if whens else column


_REASON = f"""CASE orden
    WHEN 'editar_servicio' THEN CASE
        WHEN estado_ciclo <> 'Pendiente Palpación 1' THEN '{_STATE["editar_servicio"]}'
        WHEN o_fecha > DATE '{AS_OF}' THEN 'La fecha de inicio no puede ser futura.'
        WHEN o_tipo NOT IN ('Monta Natural', 'Inseminación Artificial') THEN 'tipo de evento inválido'
        WHEN sin_vet THEN 'veterinario inexistente' END
    WHEN 'registrar_palpacion1' THEN CASE
        WHEN estado_ciclo <> 'Pendiente Palpación 1' THEN '{_STATE["registrar_palpacion1"]}'
        WHEN o_resultado NOT IN ('Preñada', 'Vacía') THEN '{_CHECK}'
        WHEN sin_vet THEN 'veterinario inexistente'
        WHEN o_fecha < fecha_inicio THEN 'fecha anterior al inicio del ciclo' END
    WHEN 'editar_palpacion1' THEN CASE
        WHEN estado_ciclo <> 'Preñez Provisional' THEN '{_STATE["editar_palpacion1"]}'
        WHEN o_fecha < fecha_inicio OR o_fecha > DATE '{AS_OF}'
            THEN 'Fecha de palpación inválida (debe ser posterior al servicio y no futura).'
        WHEN sin_vet THEN 'veterinario inexistente' END
    WHEN 'registrar_palpacion2' THEN CASE
        WHEN estado_ciclo <> 'Preñez Provisional' THEN '{_STATE["registrar_palpacion2"]}'
        WHEN o_resultado NOT IN ('Preñada', 'Vacía') THEN '{_CHECK}'
        WHEN sin_vet THEN 'veterinario inexistente'
        WHEN o_fecha < fecha_inicio THEN 'fecha anterior al inicio del ciclo' END
    WHEN 'editar_palpacion2' THEN CASE
        WHEN estado_ciclo <> 'Preñez Confirmada' THEN '{_STATE["editar_palpacion2"]}'
        WHEN o_fecha < fecha_palpacion1 OR o_fecha > DATE '{AS_OF}'
            THEN 'La fecha debe ser posterior a la Palpación 1 y no futura.'
        WHEN o_fecha < fecha_inicio THEN 'fecha anterior al inicio del ciclo' END
    WHEN 'registrar_parto' THEN CASE
        WHEN estado_ciclo <> 'Preñez Confirmada' THEN '{_STATE["registrar_parto"]}'
        WHEN o_resultado NOT IN ('Exitoso', 'Abortado') THEN '{_BIRTH}'
        WHEN sin_vet THEN 'veterinario inexistente'
        WHEN o_fecha < fecha_inicio THEN 'fecha anterior al inicio del ciclo' END
    WHEN 'editar_parto' THEN CASE
        WHEN estado_ciclo NOT IN ('Parto Exitoso', 'Abortado') THEN '{_STATE["editar_parto"]}'
        WHEN o_fecha < fecha_palpacion2 OR o_fecha > DATE '{AS_OF}'
            THEN 'Fecha de parto no puede ser anterior a Palpación 2 ni futura.' END
    END"""

_VERB = """CASE WHEN motivo IS NOT NULL THEN 'nada' ELSE CASE orden
    WHEN 'editar_servicio' THEN 'servicio'
    WHEN 'registrar_palpacion1' THEN 'palpa1'
    WHEN 'registrar_palpacion2' THEN 'palpa2'
    WHEN 'registrar_parto' THEN 'parto'
    WHEN 'editar_palpacion1' THEN CASE
        WHEN resultado_palpacion1 = 'Preñada' AND o_resultado = 'Vacía' THEN 'vacia1'
        WHEN o_fecha <> fecha_palpacion1 THEN 'fecha1' ELSE 'veterinario1' END
    WHEN 'editar_palpacion2' THEN CASE
        WHEN resultado_palpacion2 = 'Preñada' AND o_resultado = 'Vacía' THEN 'vacia2'
        WHEN o_fecha <> fecha_palpacion2 THEN 'fecha2' ELSE 'nada' END
    WHEN 'editar_parto' THEN CASE
        WHEN resultado_parto = 'Exitoso' AND o_resultado = 'Abortado' THEN 'aborta'
        WHEN resultado_parto = 'Abortado' AND o_resultado = 'Exitoso' THEN 'nace' ELSE 'nada' END
    END END"""

_RUN = f"""
    WITH RECURSIVE pedidos AS (
        SELECT id_ciclo * 16 + (id_ciclo * 5 + k * 3) % 16 AS seq, id_ciclo, id_animal, id_ciclo % 7 AS o_usuario,
               ['registrar_palpacion1', 'editar_servicio', 'registrar_palpacion2', 'editar_palpacion1',
                'registrar_parto', 'editar_palpacion2', 'editar_parto', 'iniciar_ciclo'][k % 8 + 1] AS orden,
               fecha_inicio + CAST([31, id_ciclo % 3, 62, 30 + id_ciclo % 4 + k, 280, 60 + id_ciclo % 5 + k, 284, 300]
                                   [k % 8 + 1] AS INT) AS o_fecha,
               CASE WHEN k % 8 IN (4, 6) AND (id_ciclo + k) % 3 = 0 THEN 'Abortado' WHEN k % 8 IN (4, 6) THEN 'Exitoso'
                    WHEN (id_ciclo + k) % 5 = 0 THEN 'Vacía' WHEN (id_ciclo + k) % 13 = 0 THEN 'Dudosa'
                    ELSE 'Preñada' END AS o_resultado,
               CASE (id_ciclo + k) % 2 WHEN 0 THEN 'Monta Natural' ELSE 'Inseminación Artificial' END AS o_tipo,
               (id_ciclo + k) % 10 AS o_vet
        FROM fx_ciclo, (SELECT unnest(range(16)) AS k)),
    ordenes AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY id_ciclo ORDER BY seq) AS r,
               o_vet NOT IN (SELECT id_colaborador FROM tbl_colaborador) AS sin_vet
        FROM pedidos WHERE orden <> 'iniciar_ciclo'),
    paso AS (
        SELECT CAST(0 AS BIGINT) AS r, id_ciclo, id_animal, {", ".join(_KEPT)},
               {", ".join(f"{c} AS a_{c}" for c in _BEFORE)},
               CAST(-1 AS BIGINT) AS seq, '' AS orden, fecha_inicio AS o_fecha, '' AS o_resultado, '' AS o_tipo,
               CAST(0 AS BIGINT) AS o_vet, CAST(0 AS BIGINT) AS o_usuario, CAST(NULL AS VARCHAR) AS motivo,
               'nada' AS verbo
        FROM fx_ciclo_lote
        UNION ALL
        SELECT r, id_ciclo, id_animal, {", ".join(_new(c) for c in _KEPT)},
               {", ".join(f"{c} AS a_{c}" for c in _BEFORE)}, {", ".join(_ORDER)}, motivo, verbo
        FROM (SELECT *, {_VERB} AS verbo FROM (
              SELECT *, {_REASON} AS motivo FROM (
              SELECT o.r, p.id_ciclo, p.id_animal, {", ".join("p." + c for c in _KEPT)},
                     {", ".join("o." + c for c in _ORDER)}, o.sin_vet
              FROM paso p JOIN ordenes o ON o.id_ciclo = p.id_ciclo AND o.r = p.r + 1) x) y) z),
    pasos AS (SELECT * FROM paso),
    final AS (SELECT * FROM pasos QUALIFY row_number() OVER (PARTITION BY id_ciclo ORDER BY r DESC) = 1),
    hecho AS (SELECT * FROM pasos WHERE r > 0 AND verbo <> 'nada'),
    cierre AS (
        SELECT id_ciclo, id_animal, min(seq) FILTER (estado_ciclo IN ('Vacía', 'Parto Exitoso', 'Abortado')) AS cierra
        FROM pasos GROUP BY id_ciclo, id_animal),
    libre AS (
        SELECT id_animal, max(cierra) AS desde, bool_or(cierra IS NULL) AS ocupada FROM cierre GROUP BY id_animal),
    inicio AS (
        SELECT o.*, CASE WHEN l.ocupada OR o.seq < l.desde THEN '{_BUSY}'
            WHEN o.id_animal NOT IN (SELECT id_animal FROM tbl_animal) THEN 'animal inexistente'
            WHEN o_vet NOT IN (SELECT id_colaborador FROM tbl_colaborador) THEN 'veterinario inexistente' END AS motivo
        FROM pedidos o LEFT JOIN libre l ON l.id_animal = o.id_animal WHERE orden = 'iniciar_ciclo'),
    primero AS (SELECT id_animal, min(seq) AS seq FROM inicio WHERE motivo IS NULL GROUP BY id_animal),
    nuevo AS (
        SELECT i.*, (SELECT max(id_ciclo) FROM fx_ciclo_lote) + row_number() OVER (ORDER BY i.seq) AS id_nuevo
        FROM inicio i JOIN primero p ON p.seq = i.seq)
"""

_ALERTS = f"""
    , creada AS (
        SELECT seq, id_ciclo, id_animal, 'Palpación 2' AS tipo, fecha_estimada_palp2 AS dia
        FROM hecho WHERE verbo = 'palpa1' AND o_resultado = 'Preñada'
        UNION ALL
        SELECT seq, id_ciclo, id_animal, 'Parto Estimado', fecha_estimada_parto
        FROM hecho WHERE verbo = 'palpa2' AND o_resultado = 'Preñada'
        UNION ALL
        SELECT seq, id_ciclo, id_animal, 'Seguimiento de Celo', DATE '{AS_OF}' + 21
        FROM hecho WHERE verbo IN ('vacia1', 'vacia2') OR (verbo IN ('palpa1', 'palpa2') AND o_resultado = 'Vacía')
                      OR (verbo = 'parto' AND o_resultado = 'Abortado')
        UNION ALL
        SELECT seq, id_ciclo, id_animal, 'Seguimiento de Celo', o_fecha + 21 FROM hecho WHERE verbo = 'aborta'
        UNION ALL
        SELECT seq, id_nuevo, id_animal, 'Palpación 1', o_fecha + 30 FROM nuevo),
    alerta AS (
        SELECT id_alerta, id_ciclo, id_animal, tipo_alerta, fecha_programada, estado_alerta, CAST(-1 AS BIGINT) AS desde
        FROM tbl_alerta_reproductiva
        UNION ALL
        SELECT (SELECT max(id_alerta) FROM tbl_alerta_reproductiva) + row_number() OVER (ORDER BY seq),
               id_ciclo, id_animal, tipo, dia, 'Pendiente', seq FROM creada),
    efecto AS (
        SELECT id_ciclo, seq, 'Palpación 1' AS tipo, 'Completada' AS estado, CAST(NULL AS DATE) AS dia
        FROM hecho WHERE verbo = 'palpa1'
        UNION ALL
        SELECT id_ciclo, seq, 'Palpación 2', 'Completada', NULL FROM hecho WHERE verbo IN ('palpa2', 'vacia1')
        UNION ALL
        SELECT id_ciclo, seq, 'Parto Estimado', CASE verbo WHEN 'parto' THEN 'Completada' ELSE 'Cancelada' END, NULL
        FROM hecho WHERE verbo IN ('parto', 'vacia1', 'vacia2')
        UNION ALL
        SELECT id_ciclo, seq, 'Seguimiento de Celo', 'Cancelada', NULL FROM hecho WHERE verbo = 'nace'
        UNION ALL
        SELECT id_ciclo, seq, 'Palpación 1', NULL, o_fecha + 30 FROM hecho
        WHERE verbo = 'servicio' AND o_fecha <> a_fecha_inicio
        UNION ALL
        SELECT id_ciclo, seq, 'Palpación 2', NULL, o_fecha + 30 FROM hecho WHERE verbo = 'fecha1'),
    fin AS (
        SELECT a.id_alerta, min(e.seq) AS seq, min_by(e.estado, e.seq) AS estado
        FROM alerta a JOIN efecto e ON e.id_ciclo = a.id_ciclo AND e.tipo = a.tipo_alerta AND e.seq > a.desde
        WHERE a.estado_alerta = 'Pendiente' AND e.estado IS NOT NULL GROUP BY a.id_alerta),
    cambio AS (
        SELECT a.id_alerta, max_by(e.dia, e.seq) AS dia
        FROM alerta a JOIN efecto e ON e.id_ciclo = a.id_ciclo AND e.tipo = a.tipo_alerta AND e.seq > a.desde
        LEFT JOIN fin ON fin.id_alerta = a.id_alerta
        WHERE a.estado_alerta = 'Pendiente' AND e.dia IS NOT NULL AND (fin.seq IS NULL OR e.seq < fin.seq)
        GROUP BY a.id_alerta)
    SELECT a.id_alerta, a.id_ciclo, a.id_animal, a.tipo_alerta,
           coalesce(c.dia, a.fecha_programada) AS fecha_programada, coalesce(f.estado, a.estado_alerta) AS estado_alerta
    FROM alerta a LEFT JOIN fin f ON f.id_alerta = a.id_alerta LEFT JOIN cambio c ON c.id_alerta = a.id_alerta"""


def _log(verb: str, phase: str, field: str, before: str, after: str, text: str | None, when: str = "true") -> str:
    shown = f"true AS genero_cascada, '{text}'" if text else "false AS genero_cascada, CAST(NULL AS VARCHAR)"
    return (
        f"SELECT id_ciclo, o_usuario AS id_usuario, '{phase}' AS fase_editada, '{field}' AS campo_modificado, "
        f"CAST({before} AS VARCHAR) AS valor_anterior, CAST({after} AS VARCHAR) AS valor_nuevo, {shown} "
        f"AS descripcion_cascada FROM hecho WHERE verbo = '{verb}' AND {when}"
    )


_CREATED = {
    "id_ciclo": "id_nuevo", "fecha_inicio": "o_fecha", "tipo_evento": "o_tipo", "id_veterinario_inicio": "o_vet",
    "fecha_estimada_palp1": "o_fecha + 30", "fecha_estimada_palp2": "o_fecha + 60",
    "fecha_estimada_parto": "o_fecha + 283", "estado_ciclo": "'Pendiente Palpación 1'",
}

ORACLE = {
    "reproducir_ciclos__tbl_ciclo_reproductivo": f"{_RUN} SELECT id_ciclo, {', '.join(_KEPT)} FROM final UNION ALL "
    f"SELECT id_nuevo, {', '.join(_CREATED.get(c, 'NULL') for c in _KEPT)} FROM nuevo",
    "reproducir_ciclos__tbl_alerta_reproductiva": _RUN + _ALERTS,
    "reproducir_ciclos__tbl_vaca_detalle": _RUN
    + """, vaca AS (
            SELECT id_animal, max_by(CASE WHEN estado_ciclo LIKE 'Preñez%' THEN 'Preñada' ELSE 'Vacía' END, seq) AS estado
            FROM hecho WHERE estado_ciclo <> a_estado_ciclo GROUP BY id_animal)
        SELECT id_vaca_detalle, d.id_animal, CASE WHEN es_vigente THEN coalesce(v.estado, estado_reproductivo)
               ELSE estado_reproductivo END AS estado_reproductivo
        FROM tbl_vaca_detalle d LEFT JOIN vaca v ON v.id_animal = d.id_animal""",
    "reproducir_ciclos__tbl_auditoria_ciclo": _RUN
    + " UNION ALL ".join(
        [
            _log("servicio", "Servicio", "fecha_inicio", "a_fecha_inicio", "o_fecha", _MOVED, "o_fecha <> a_fecha_inicio"),
            _log("servicio", "Servicio", "tipo_evento", "a_tipo_evento", "o_tipo", None, "o_tipo <> a_tipo_evento"),
            _log("vacia1", "Palpación 1", "resultado_palpacion1", "a_resultado_palpacion1", "'Vacía'", _EMPTY_1),
            _log("fecha1", "Palpación 1", "fecha_palpacion1", "a_fecha_palpacion1", "o_fecha", _REDATED),
            _log("vacia2", "Palpación 2", "resultado_palpacion2", "'Preñada'", "'Vacía'", _EMPTY_2),
            _log("fecha2", "Palpación 2", "fecha_palpacion2", "a_fecha_palpacion2", "o_fecha", None),
            _log("aborta", "Parto", "resultado_parto", "a_resultado_parto", "o_resultado", _ABORTED),
            _log("nace", "Parto", "resultado_parto", "a_resultado_parto", "o_resultado", _BORN),
        ]
    ),
    "reproducir_ciclos__rechazadas": _RUN
    + f"""SELECT seq, motivo FROM pasos WHERE motivo IS NOT NULL
        UNION ALL
        SELECT i.seq, CASE WHEN i.seq > p.seq THEN '{_BUSY}' ELSE motivo END
        FROM inicio i LEFT JOIN primero p ON p.id_animal = i.id_animal
        WHERE motivo IS NOT NULL OR i.seq > p.seq""",
}
