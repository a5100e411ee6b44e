"""The reproductive cycle commands over the derived tables, with their oracle SQL.

The oracle states each command on its own, one request per cycle.  The replay of
mixed batches has a recursive one; tests compare it with a plain sequential run.
"""

from __future__ import annotations

from ..operators import cycles as C
from . import replay_sql
from .settings import AS_OF

CYCLE = (
    "id_ciclo",
    "fecha_inicio",
    "tipo_evento",
    "id_veterinario_inicio",
    "fecha_estimada_palp1",
    "fecha_estimada_palp2",
    "fecha_estimada_parto",
    "estado_ciclo",
    "fecha_palpacion1",
    "resultado_palpacion1",
    "id_veterinario_palp1",
    "fecha_palpacion2",
    "resultado_palpacion2",
    "id_veterinario_palp2",
    "fecha_parto_real",
    "resultado_parto",
    "id_veterinario_parto",
)
SHOWN = {
    "tbl_ciclo_reproductivo": CYCLE,
    "tbl_alerta_reproductiva": (
        "id_alerta",
        "id_ciclo",
        "id_animal",
        "tipo_alerta",
        "fecha_programada",
        "estado_alerta",
    ),
    "tbl_vaca_detalle": ("id_vaca_detalle", "id_animal", "estado_reproductivo"),
    "tbl_auditoria_ciclo": (
        "id_ciclo",
        "id_usuario",
        "fase_editada",
        "campo_modificado",
        "valor_anterior",
        "valor_nuevo",
        "genero_cascada",
        "descripcion_cascada",
    ),
    "rechazadas": ("seq", "motivo"),
}
REQUESTS = {
    "registrar_palpacion1": "fx_orden_palpacion",
    "registrar_palpacion2": "fx_orden_palpacion",
    "registrar_parto": "fx_orden_parto",
    "editar_servicio": "fx_orden_servicio",
    "editar_palpacion1": "fx_orden_palpacion",
    "editar_palpacion2": "fx_orden_palpacion",
    "editar_parto": "fx_orden_parto",
}
EDITS = [name for name in REQUESTS if name.startswith("editar")]


def _alerts(t):
    return t["tbl_alerta_reproductiva"].drop("created_at")


def _one(t, name):
    return C.reproducir_ciclos(
        t["fx_ciclo"],
        _alerts(t),
        t["tbl_vaca_detalle"],
        t["tbl_colaborador"],
        {name: t[REQUESTS[name]]},
        AS_OF,
    )


def _batch(t):
    orders = t["fx_lote"]
    return C.reproducir_ciclos(
        t["fx_ciclo_lote"],
        _alerts(t),
        t["tbl_vaca_detalle"],
        t["tbl_colaborador"],
        orders,
        AS_OF,
        inicios=orders.filter("orden = 'iniciar_ciclo'").selectExpr(
            "seq", "id_animal", "fecha AS fecha_inicio", "tipo_evento", "id_veterinario"
        ),
        animal=t["tbl_animal"],
    )


def _starts(t):
    return C.reproducir_ciclos(
        t["fx_ciclo_lote"],
        _alerts(t),
        t["tbl_vaca_detalle"],
        t["tbl_colaborador"],
        {},
        AS_OF,
        inicios=t["fx_inicio"],
        animal=t["tbl_animal"],
    )


QUERIES = {}
for _name in REQUESTS:
    for _table, _columns in SHOWN.items():
        if _table == "tbl_auditoria_ciclo" and _name not in EDITS:
            continue
        if _table == "tbl_vaca_detalle" and _name == "editar_servicio":
            continue
        QUERIES[f"{_name}__{_table}"] = lambda t, n=_name, o=_table, c=_columns: t.once(_one, n)[o].select(*c)
for _table, _columns in SHOWN.items():
    QUERIES[f"reproducir_ciclos__{_table}"] = lambda t, o=_table, c=_columns: t.once(_batch)[o].select(*c)
for _table in ("tbl_ciclo_reproductivo", "tbl_alerta_reproductiva", "rechazadas"):
    QUERIES[f"iniciar_ciclos__{_table}"] = lambda t, o=_table, c=SHOWN[_table]: t.once(_starts)[o].select(*c)


# -- oracle ------------------------------------------------------------------------

_VET = "WHEN o.id_veterinario = 999999999 THEN 'veterinario inexistente'"
_CHK = "WHEN o.fecha < c.fecha_inicio THEN 'fecha anterior al inicio del ciclo'"
_FUTURE = f"o.fecha > DATE '{AS_OF}'"
_HEAT = f"DATE '{AS_OF}' + 21"
_TO_EMPTY_1 = "resultado_palpacion1 = 'Preñada' AND o_resultado = 'Vacía'"
_TO_EMPTY_2 = "resultado_palpacion2 = 'Preñada' AND o_resultado = 'Vacía'"
_ABORT = "resultado_parto = 'Exitoso' AND o_resultado = 'Abortado'"
_BORN = "resultado_parto = 'Abortado' AND o_resultado = 'Exitoso'"

# Per command: refusal, new column values, cow state, state of pending alerts, new alerts, audit rows.
RULES = {
    "registrar_palpacion1": {
        "state": "c.estado_ciclo = 'Pendiente Palpación 1'",
        "refuse": f"WHEN o.resultado = 'Dudosa' THEN '{C.BAD_CHECK}' {_VET} {_CHK}",
        "set": {
            "estado_ciclo": "if(o_resultado = 'Vacía', 'Vacía', 'Preñez Provisional')",
            "fecha_palpacion1": "o_fecha",
            "resultado_palpacion1": "o_resultado",
            "id_veterinario_palp1": "o_vet",
        },
        "cow": "o_resultado",
        "alert": "if(tipo_alerta = 'Palpación 1', 'Completada', estado_alerta)",
        "new": [("Palpación 2", "fecha_estimada_palp2", "o_resultado = 'Preñada'"),
                ("Seguimiento de Celo", _HEAT, "o_resultado = 'Vacía'")],
    },
    "registrar_palpacion2": {
        "state": "c.estado_ciclo = 'Preñez Provisional'",
        "refuse": f"WHEN o.resultado = 'Dudosa' THEN '{C.BAD_CHECK}' {_VET} {_CHK}",
        "set": {
            "estado_ciclo": "if(o_resultado = 'Vacía', 'Vacía', 'Preñez Confirmada')",
            "fecha_palpacion2": "o_fecha",
            "resultado_palpacion2": "o_resultado",
            "id_veterinario_palp2": "o_vet",
        },
        "cow": "o_resultado",
        "alert": "if(tipo_alerta = 'Palpación 2', 'Completada', estado_alerta)",
        "new": [("Parto Estimado", "fecha_estimada_parto", "o_resultado = 'Preñada'"),
                ("Seguimiento de Celo", _HEAT, "o_resultado = 'Vacía'")],
    },
    "registrar_parto": {
        "state": "c.estado_ciclo = 'Preñez Confirmada'",
        "refuse": f"WHEN o.resultado = 'Dudoso' THEN '{C.BAD_BIRTH}' {_VET} {_CHK}",
        "set": {
            "estado_ciclo": "if(o_resultado = 'Exitoso', 'Parto Exitoso', 'Abortado')",
            "fecha_parto_real": "o_fecha",
            "resultado_parto": "o_resultado",
            "id_veterinario_parto": "o_vet",
        },
        "cow": "'Vacía'",
        "alert": "if(tipo_alerta = 'Parto Estimado', 'Completada', estado_alerta)",
        "new": [("Seguimiento de Celo", _HEAT, "o_resultado = 'Abortado'")],
    },
    "editar_servicio": {
        "state": "c.estado_ciclo = 'Pendiente Palpación 1'",
        "refuse": f"WHEN {_FUTURE} THEN '{C.FUTURE_START}' "
        f"WHEN o.tipo_evento = 'Otro' THEN 'tipo de evento inválido' {_VET}",
        "set": {
            "fecha_inicio": "o_fecha",
            "tipo_evento": "o_tipo",
            "id_veterinario_inicio": "o_vet",
            "fecha_estimada_palp1": "o_fecha + 30",
            "fecha_estimada_palp2": "o_fecha + 60",
            "fecha_estimada_parto": "o_fecha + 283",
        },
        "date": "if(tipo_alerta = 'Palpación 1' AND o_fecha <> fecha_inicio, o_fecha + 30, fecha_programada)",
        "audit": [
            ("o_fecha <> fecha_inicio", "Servicio", "fecha_inicio", "fecha_inicio", "o_fecha", C.CASCADE_START),
            ("o_tipo <> tipo_evento", "Servicio", "tipo_evento", "tipo_evento", "o_tipo", None),
        ],
    },
    "editar_palpacion1": {
        "state": "c.estado_ciclo = 'Preñez Provisional'",
        "refuse": f"WHEN o.fecha < c.fecha_inicio OR {_FUTURE} THEN '{C.BAD_DATE_1}' {_VET}",
        "set": {
            "estado_ciclo": f"if({_TO_EMPTY_1}, 'Vacía', estado_ciclo)",
            "fecha_palpacion1": "o_fecha",
            "resultado_palpacion1": f"if({_TO_EMPTY_1}, 'Vacía', resultado_palpacion1)",
            "id_veterinario_palp1": "o_vet",
            "fecha_estimada_palp2": f"if(NOT ({_TO_EMPTY_1}) AND o_fecha <> fecha_palpacion1, o_fecha + 30, "
            "fecha_estimada_palp2)",
        },
        "cow": f"if({_TO_EMPTY_1}, 'Vacía', NULL)",
        "alert": f"CASE WHEN {_TO_EMPTY_1} AND tipo_alerta = 'Palpación 2' THEN 'Completada' "
        f"WHEN {_TO_EMPTY_1} AND tipo_alerta = 'Parto Estimado' THEN 'Cancelada' ELSE estado_alerta END",
        "date": f"if(tipo_alerta = 'Palpación 2' AND NOT ({_TO_EMPTY_1}) AND o_fecha <> fecha_palpacion1, "
        "o_fecha + 30, fecha_programada)",
        "new": [("Seguimiento de Celo", _HEAT, _TO_EMPTY_1)],
        "audit": [
            (_TO_EMPTY_1, "Palpación 1", "resultado_palpacion1", "resultado_palpacion1", "'Vacía'",
             C.CASCADE_EMPTY_1),
            (f"NOT ({_TO_EMPTY_1}) AND o_fecha <> fecha_palpacion1", "Palpación 1", "fecha_palpacion1",
             "fecha_palpacion1", "o_fecha", C.CASCADE_DATE_1),
        ],
    },
    "editar_palpacion2": {
        "state": "c.estado_ciclo = 'Preñez Confirmada'",
        "refuse": f"WHEN o.fecha < c.fecha_palpacion1 OR {_FUTURE} THEN '{C.BAD_DATE_2}'",
        "set": {
            "estado_ciclo": f"if({_TO_EMPTY_2}, 'Vacía', estado_ciclo)",
            "fecha_palpacion2": "o_fecha",
            "resultado_palpacion2": f"if({_TO_EMPTY_2}, 'Vacía', resultado_palpacion2)",
        },
        "cow": f"if({_TO_EMPTY_2}, 'Vacía', NULL)",
        "alert": f"if({_TO_EMPTY_2} AND tipo_alerta = 'Parto Estimado', 'Cancelada', estado_alerta)",
        "new": [("Seguimiento de Celo", _HEAT, _TO_EMPTY_2)],
        "audit": [
            (_TO_EMPTY_2, "Palpación 2", "resultado_palpacion2", "resultado_palpacion2", "'Vacía'",
             C.CASCADE_EMPTY_2),
            (f"NOT ({_TO_EMPTY_2}) AND o_fecha <> fecha_palpacion2", "Palpación 2", "fecha_palpacion2",
             "fecha_palpacion2", "o_fecha", None),
        ],
    },
    "editar_parto": {
        "state": "c.estado_ciclo IN ('Parto Exitoso', 'Abortado')",
        "refuse": f"WHEN o.fecha < c.fecha_palpacion2 OR {_FUTURE} THEN '{C.BAD_DATE_3}'",
        "set": {
            "estado_ciclo": f"CASE WHEN {_ABORT} THEN 'Abortado' WHEN {_BORN} THEN 'Parto Exitoso' "
            "ELSE estado_ciclo END",
            "resultado_parto": f"if({_ABORT} OR {_BORN}, o_resultado, resultado_parto)",
        },
        "cow": f"if({_ABORT} OR {_BORN}, 'Vacía', NULL)",
        "alert": f"if({_BORN} AND tipo_alerta = 'Seguimiento de Celo', 'Cancelada', estado_alerta)",
        "new": [("Seguimiento de Celo", "o_fecha + 21", _ABORT)],
        "audit": [
            (_ABORT, "Parto", "resultado_parto", "resultado_parto", "o_resultado", C.CASCADE_ABORTED),
            (_BORN, "Parto", "resultado_parto", "resultado_parto", "o_resultado", C.CASCADE_BORN),
        ],
    },
}


def _head(name):
    rule = RULES[name]
    kind = "o.tipo_evento" if name == "editar_servicio" else "CAST(NULL AS VARCHAR)"
    result = "CAST(NULL AS VARCHAR)" if name == "editar_servicio" else "o.resultado"
    return f"""
        WITH pedido AS (
            SELECT c.*, o.seq, o.id_usuario AS o_usuario, o.fecha AS o_fecha, {result} AS o_resultado,
                   {kind} AS o_tipo, o.id_veterinario AS o_vet,
                   CASE WHEN NOT ({rule["state"]}) THEN '{C.NEEDS[name]}' {rule["refuse"]} END AS motivo
            FROM {REQUESTS[name]} o JOIN fx_ciclo c ON c.id_ciclo = o.id_ciclo),
        hecho AS (SELECT * FROM pedido WHERE motivo IS NULL)
    """


def _cycle_sql(name):
    new = RULES[name]["set"]
    columns = ", ".join(
        f"CASE WHEN motivo IS NULL THEN {new[c]} ELSE {c} END AS {c}" if c in new else c for c in CYCLE
    )
    return f"{_head(name)} SELECT {columns} FROM pedido"


def _alert_sql(name):
    rule = RULES[name]
    hit = "h.id_ciclo IS NOT NULL AND estado_alerta = 'Pendiente'"
    sql = f"""{_head(name)}
        SELECT a.id_alerta, a.id_ciclo, a.id_animal, a.tipo_alerta,
               CASE WHEN {hit} THEN {rule.get("date", "fecha_programada")} ELSE fecha_programada END
                   AS fecha_programada,
               CASE WHEN {hit} THEN {rule.get("alert", "estado_alerta")} ELSE estado_alerta END AS estado_alerta
        FROM tbl_alerta_reproductiva a LEFT JOIN (SELECT * EXCLUDE (id_animal) FROM hecho) h
          ON h.id_ciclo = a.id_ciclo"""
    if rule.get("new"):
        made = " UNION ALL ".join(
            f"SELECT seq, id_ciclo, id_animal, '{kind}' AS tipo, {day} AS dia FROM hecho WHERE {when}"
            for kind, day, when in rule["new"]
        )
        sql += f"""
        UNION ALL
        SELECT (SELECT max(id_alerta) FROM tbl_alerta_reproductiva) + row_number() OVER (ORDER BY seq),
               id_ciclo, id_animal, tipo, dia, 'Pendiente' FROM ({made}) n"""
    return sql


def _cow_sql(name):
    return f"""{_head(name)},
        vaca AS (
            SELECT id_animal, max_by(estado, seq) AS estado
            FROM (SELECT id_animal, seq, {RULES[name]["cow"]} AS estado FROM hecho) e
            WHERE estado IS NOT NULL GROUP BY id_animal)
        SELECT d.id_vaca_detalle, d.id_animal, CASE WHEN d.es_vigente AND v.estado IS NOT NULL
               THEN v.estado ELSE d.estado_reproductivo END AS estado_reproductivo
        FROM tbl_vaca_detalle d LEFT JOIN vaca v ON v.id_animal = d.id_animal"""


def _audit_sql(name):
    return _head(name) + " UNION ALL ".join(
        f"SELECT id_ciclo, o_usuario AS id_usuario, '{phase}' AS fase_editada, '{field}' AS campo_modificado, "
        f"CAST({before} AS VARCHAR) AS valor_anterior, CAST({after} AS VARCHAR) AS valor_nuevo, "
        f"{str(bool(text)).lower()} AS genero_cascada, "
        + (f"'{text}'" if text else "CAST(NULL AS VARCHAR)")
        + f" AS descripcion_cascada FROM hecho WHERE {when}"
        for when, phase, field, before, after, text in RULES[name]["audit"]
    )


_WRITERS = {
    "tbl_ciclo_reproductivo": _cycle_sql,
    "tbl_alerta_reproductiva": _alert_sql,
    "tbl_vaca_detalle": _cow_sql,
    "tbl_auditoria_ciclo": _audit_sql,
    "rechazadas": lambda name: _head(name) + "SELECT seq, motivo FROM pedido WHERE motivo IS NOT NULL",
}
ORACLE = {
    query: _WRITERS[query.split("__")[1]](query.split("__")[0])
    for query in QUERIES
    if query.split("__")[0] in REQUESTS
}

_STARTS = f"""
    WITH pedido AS (
        SELECT o.*, CASE
            WHEN EXISTS (SELECT 1 FROM fx_ciclo_lote c WHERE c.id_animal = o.id_animal
                         AND c.estado_ciclo NOT IN ('Parto Exitoso', 'Abortado', 'Vacía')) THEN '{C.BUSY}'
            WHEN fecha_inicio IS NULL THEN 'fecha de inicio ausente'
            WHEN id_veterinario = 999999999 THEN 'veterinario inexistente' END AS motivo
        FROM fx_inicio o),
    nuevo AS (
        SELECT *, (SELECT max(id_ciclo) FROM fx_ciclo_lote) + row_number() OVER (ORDER BY seq) AS id_ciclo,
               (SELECT max(id_alerta) FROM tbl_alerta_reproductiva) + row_number() OVER (ORDER BY seq) AS id_alerta
        FROM pedido WHERE motivo IS NULL)
"""
_new_cycle = {
    "id_ciclo": "id_ciclo",
    "fecha_inicio": "fecha_inicio",
    "tipo_evento": "tipo_evento",
    "id_veterinario_inicio": "id_veterinario",
    "fecha_estimada_palp1": "fecha_inicio + 30",
    "fecha_estimada_palp2": "fecha_inicio + 60",
    "fecha_estimada_parto": "fecha_inicio + 283",
    "estado_ciclo": "'Pendiente Palpación 1'",
}
ORACLE |= {
    "iniciar_ciclos__tbl_ciclo_reproductivo": f"{_STARTS} SELECT {', '.join(CYCLE)} FROM fx_ciclo_lote "
    f"UNION ALL SELECT {', '.join(_new_cycle.get(c, 'NULL') for c in CYCLE)} FROM nuevo",
    "iniciar_ciclos__tbl_alerta_reproductiva": f"""{_STARTS}
        SELECT id_alerta, id_ciclo, id_animal, tipo_alerta, fecha_programada, estado_alerta
        FROM tbl_alerta_reproductiva
        UNION ALL
        SELECT id_alerta, id_ciclo, id_animal, 'Palpación 1', fecha_inicio + 30, 'Pendiente' FROM nuevo""",
    "iniciar_ciclos__rechazadas": f"{_STARTS} SELECT seq, motivo FROM pedido WHERE motivo IS NOT NULL",
}
ORACLE |= replay_sql.ORACLE
