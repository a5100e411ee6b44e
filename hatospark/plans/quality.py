"""The data-quality jobs over the intake tables, with their oracle SQL.

The oracle lists one SELECT per rule of the model; Spark reads each table once.
"""

from __future__ import annotations

from ..functions.checkpoints import new_folder
from ..model.columns import RESTRICT
from ..model.tables import TABLES, foreign_keys
from ..operators import quality as Q
from ..operators.intake import take_in
from ..sources.derived import delivered_columns
from .settings import AS_OF, RUN_TS


def _intake(t):
    return t.intake


#: Rows of the source files for one share of keys: they bring three to four keys each.
ROWS_A_SHARE = 250_000


def _shares(rows: int, least: int) -> int:
    """As many shares as the rows ask for, ``least`` or more where that many can be written unsorted."""
    return min(max(rows // ROWS_A_SHARE, least), Q.MOST_SHARES)


def _duplicates(t):
    shares = _shares(t.base_rows(), t.spark.sparkContext.defaultParallelism)
    return Q.duplicate_keys(_intake(t), delivered_columns, shares)


# Keys deleted and renamed by the D08 / D09 runs.
def _some_animals(t):
    return t.intake("tbl_animal").filter("id_animal % 97 = 0").select("id_animal")


def _one_pen(t):
    return t.intake("tbl_manga").filter("id_manga = 5").select("id_manga")


def _animal_renames(t):
    return _some_animals(t).selectExpr("id_animal AS old", "id_animal + 1000000 AS new")


def _pen_renames(t):
    return _one_pen(t).selectExpr("id_manga AS old", "id_manga + 1000 AS new")


def _deleted(t, table):
    keys = _some_animals(t) if table == "tbl_animal" else _one_pen(t)
    return Q.delete_rows(_intake(t), table, keys)


def _renamed(t, table):
    renames = _animal_renames(t) if table == "tbl_animal" else _pen_renames(t)
    return Q.rename_keys(_intake(t), table, renames)


GENERATED = {
    "tbl_produccion_leche": ["total_litros"],
    "tbl_movimiento_insumo": ["total"],
    "tbl_transaccion_animal": ["comision_monto", "neto_recibido"],
    "tbl_transaccion_leche": ["ingreso_bruto", "ingreso_neto"],
}
DEFAULTED = {
    "tbl_animal": "id_animal, fecha_ingreso, estado_animal",
    "tbl_alerta": "id_alerta, prioridad, estado, enviar_correo, correo_enviado, notificacion_vista",
    "tbl_mastitis_cuartos": "id_mastitis, cuarto_ad, cuarto_pd, cuarto_ai, cuarto_pi, en_tratamiento",
    "tbl_movimiento_manga": "id_movimiento, fecha_movimiento",
    "tbl_transaccion_financiera": "id_transaccion, estado, tipo_origen",
}
ANIMAL_CHILDREN = {
    "tbl_animal": "id_animal, arete",
    "tbl_pesaje": "id_pesaje, id_animal",
    "tbl_toro_detalle": "id_toro_detalle, id_animal",
    "tbl_toro_inseminacion": "id_inseminacion, id_toro_detalle",
    "tbl_ternero_detalle": "id_ternero_detalle, id_animal, id_madre, id_padre",
    "tbl_alerta": "id_alerta, id_animal",
    "tbl_auditoria_alerta": "id_auditoria, id_alerta, id_animal",
    "tbl_registro_sanitario_animal": "id_registro_san, id_animal",
}


#: Tables whose rows get defaults or stored columns when they come in.
TAKEN_IN = sorted({*GENERATED, *DEFAULTED})


def _taken_in(t):
    """The broken rules of the tables taken in, as the write counts them: a row per table and rule."""
    found = []
    for name in TAKEN_IN:
        rows = t.intake(name).select(*delivered_columns(name))
        total, broken = take_in(rows, TABLES[name], AS_OF, RUN_TS, new_folder(t.spark, f"in-{name}"))
        found += [(name, kind, rule, total, n) for (kind, rule), n in broken.items() if n]
    return t.spark.createDataFrame(found, "tabla string, clase string, nombre string, filas long, rotas long")


def _pick(df, columns):
    return df.select(*(c.strip() for c in columns.split(",")))


QUERIES = {
    "fk_huerfanos": lambda t: Q.orphans(_intake(t), delivered_columns),
    "claves_duplicadas": _duplicates,
    "checks_fila": lambda t: Q.broken_checks(_intake(t), delivered_columns),
    "dominios_enum": lambda t: Q.outside_domain(_intake(t), delivered_columns),
    "nulos_y_longitud": lambda t: Q.nulls_and_lengths(_intake(t), delivered_columns),
}
for _name, _cols in GENERATED.items():
    QUERIES[f"columnas_generadas__{_name}"] = lambda t, n=_name, c=_cols: Q.with_generated(
        t.narrow(n), TABLES[n]
    ).select(TABLES[n].key, *c)
for _name, _cols in DEFAULTED.items():
    QUERIES[f"valores_defecto__{_name}"] = lambda t, n=_name, c=_cols: _pick(
        Q.fill_defaults(t.narrow(n), TABLES[n], AS_OF, RUN_TS), c
    )
QUERIES["ingesta_reglas"] = _taken_in
QUERIES["borrado_en_cascada__bloqueados"] = lambda t: t.once(_deleted, "tbl_animal")["bloqueados"]
for _name, _cols in ANIMAL_CHILDREN.items():
    QUERIES[f"borrado_en_cascada__{_name}"] = lambda t, n=_name, c=_cols: _pick(
        t.once(_deleted, "tbl_animal")[n], c
    )
QUERIES["borrado_en_cascada__manga_bloqueada"] = lambda t: t.once(_deleted, "tbl_manga")["bloqueados"]
QUERIES["cambio_de_clave__bloqueados"] = lambda t: t.once(_renamed, "tbl_animal")["bloqueados"]
for _name, _cols in ANIMAL_CHILDREN.items():
    if _name in ("tbl_toro_inseminacion", "tbl_auditoria_alerta"):
        continue
    QUERIES[f"cambio_de_clave__{_name}"] = lambda t, n=_name, c=_cols: _pick(
        t.once(_renamed, "tbl_animal")[n], c
    )
QUERIES["cambio_de_clave__manga_tbl_animal"] = lambda t: t.once(_renamed, "tbl_manga")["tbl_animal"].select("id_animal", "id_manga_actual")


# -- oracle ------------------------------------------------------------------------


def _delivered(table):
    names = set(delivered_columns(table.name))
    return [c for c in table.columns if c.name in names]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _fk_sql():
    return _union(
        f"SELECT '{t.name}' AS tabla, '{c.name}' AS columna, '{c.parent}' AS padre, "
        f"CAST({c.name} AS BIGINT) AS clave, count(*) AS filas FROM in_{t.name} x "
        f"WHERE {c.name} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM in_{c.parent} y "
        f"WHERE y.{TABLES[c.parent].key} = x.{c.name}) GROUP BY {c.name}"
        for t, c in foreign_keys()
        if c in _delivered(t)
    )


def _duplicates_sql():
    parts = []
    for t in TABLES.values():
        have = {c.name for c in _delivered(t)}
        for cols in ((t.key,), *t.unique):
            if not have.issuperset(cols):
                continue
            value = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
            same = f"strip_accents(lower(rtrim({value})))"
            parts.append(
                f"SELECT '{t.name}' AS tabla, '{'+'.join(cols)}' AS restriccion, min({value}) AS clave, "
                f"count(*) AS filas FROM in_{t.name} WHERE {value} IS NOT NULL "
                f"GROUP BY {same} HAVING count(*) > 1"
            )
    return _union(parts)


def _checks_sql():
    parts = []
    for t in TABLES.values():
        have = {c.name for c in _delivered(t)}
        for name, rule in t.checks.items():
            if rule.split()[0] not in have:
                continue
            if "RLIKE" in rule:
                column = rule.split()[0]
                rule = f"regexp_matches({column}, '^[0-9]{{6}}$')"
            parts.append(
                f"SELECT '{t.name}' AS tabla, '{name}' AS regla, CAST({t.key} AS BIGINT) AS clave "
                f"FROM in_{t.name} WHERE NOT ({rule})"
            )
    return _union(parts)


def _domain_sql():
    return _union(
        f"SELECT '{t.name}' AS tabla, '{c.name}' AS columna, {c.name} AS valor, "
        f"CAST({t.key} AS BIGINT) AS clave FROM in_{t.name} WHERE {c.name} NOT IN ("
        + ", ".join(f"'{w}'" for w in c.domain)
        + ")"
        for t in TABLES.values()
        for c in _delivered(t)
        if c.domain
    )


def _nulls_sql():
    parts = []
    for t in TABLES.values():
        for c in _delivered(t):
            tests = []
            if not c.nullable:
                tests.append(("nulo", f"{c.name} IS NULL"))
            if c.size:
                tests.append(("longitud", f"length({c.name}) > {c.size}"))
            parts += [
                f"SELECT '{t.name}' AS tabla, '{c.name}' AS columna, '{p}' AS problema, "
                f"CAST({t.key} AS BIGINT) AS clave FROM in_{t.name} WHERE {w}"
                for p, w in tests
            ]
    return _union(parts)


def _taken_in_sql():
    """The separate rule queries, counted."""
    names = "(" + ", ".join(f"'{n}'" for n in TAKEN_IN) + ")"
    sizes = _union(f"SELECT '{n}' AS tabla, count(*) AS filas FROM in_{n}" for n in TAKEN_IN)
    broken = _union([
        f"SELECT tabla, 'regla' AS clase, regla AS nombre FROM ({_checks_sql()}) a",
        f"SELECT tabla, 'dominio', columna FROM ({_domain_sql()}) b",
        f"SELECT tabla, problema, columna FROM ({_nulls_sql()}) c",
    ])
    return (
        f"SELECT tabla, clase, nombre, any_value(filas) AS filas, count(*) AS rotas FROM ({broken}) x "
        f"JOIN ({sizes}) y USING (tabla) WHERE tabla IN {names} GROUP BY tabla, clase, nombre"
    )


def _restricted(parent, alias, update=False):
    return [
        f"EXISTS (SELECT 1 FROM in_{t.name} r WHERE r.{c.name} = {alias})"
        for t, c in foreign_keys()
        if c.parent == parent
        and c in _delivered(t)
        and (not c.update_cascades if update else c.on_delete == RESTRICT)
    ]


def _animals_sql(blocked: bool, update=False):
    test = " OR ".join(_restricted("tbl_animal", "a.id_animal", update))
    return (
        "SELECT a.id_animal FROM in_tbl_animal a WHERE a.id_animal % 97 = 0 AND "
        f"{'' if blocked else 'NOT '}({test})"
    )


_GONE = f"WITH fuera AS ({_animals_sql(False)})\n"
_IN = "IN (SELECT id_animal FROM fuera)"
_GONE_BULLS = f"(SELECT id_toro_detalle FROM in_tbl_toro_detalle WHERE id_animal {_IN})"
_GONE_ALERTS = f"(SELECT id_alerta FROM in_tbl_alerta WHERE id_animal {_IN})"
_KEPT = f"(id_animal IS NULL OR id_animal NOT {_IN})"


def _null_out(column):
    return f"CASE WHEN {column} {_IN} THEN NULL ELSE {column} END AS {column}"


_MOVED = f"WITH cambia AS ({_animals_sql(False, update=True)})\n"


def _moved(column):
    return (
        f"CASE WHEN {column} IN (SELECT id_animal FROM cambia) THEN {column} + 1000000 "
        f"ELSE {column} END AS {column}"
    )


ORACLE = {
    "ingesta_reglas": _taken_in_sql(),
    "fk_huerfanos": _fk_sql(),
    "claves_duplicadas": _duplicates_sql(),
    "checks_fila": _checks_sql(),
    "dominios_enum": _domain_sql(),
    "nulos_y_longitud": _nulls_sql(),
    "columnas_generadas__tbl_produccion_leche": """
        SELECT id_produccion, CAST(litros_manana + litros_tarde AS DECIMAL(6,2)) AS total_litros
        FROM tbl_produccion_leche""",
    "columnas_generadas__tbl_movimiento_insumo": """
        SELECT id_mov_insumo, CAST(cantidad * coalesce(precio_unitario, 0) AS DECIMAL(12,2)) AS total
        FROM tbl_movimiento_insumo""",
    "columnas_generadas__tbl_transaccion_animal": """
        SELECT id_trans_animal,
               CAST(CAST(precio_acordado * comision_pct AS DECIMAL(18,4)) * 0.01 AS DECIMAL(12,2)) AS comision_monto,
               CAST(precio_acordado - CAST(precio_acordado * comision_pct AS DECIMAL(18,4)) * 0.01
                    AS DECIMAL(12,2)) AS neto_recibido
        FROM tbl_transaccion_animal""",
    "columnas_generadas__tbl_transaccion_leche": """
        SELECT id_trans_leche, CAST(total_litros * precio_litro AS DECIMAL(12,2)) AS ingreso_bruto,
               CAST(total_litros * precio_litro - descuentos AS DECIMAL(12,2)) AS ingreso_neto
        FROM tbl_transaccion_leche""",
    "valores_defecto__tbl_animal": f"""
        SELECT id_animal, DATE '{AS_OF}' AS fecha_ingreso, estado_animal FROM tbl_animal""",
    "valores_defecto__tbl_alerta": """
        SELECT id_alerta, prioridad, estado, false AS enviar_correo, false AS correo_enviado,
               false AS notificacion_vista FROM tbl_alerta""",
    "valores_defecto__tbl_mastitis_cuartos": """
        SELECT id_mastitis, cuarto_ad, 'Sana' AS cuarto_pd, 'Sana' AS cuarto_ai, 'Sana' AS cuarto_pi,
               false AS en_tratamiento FROM tbl_mastitis_cuartos""",
    "valores_defecto__tbl_movimiento_manga": """
        SELECT id_movimiento, fecha_movimiento FROM tbl_movimiento_manga""",
    "valores_defecto__tbl_transaccion_financiera": """
        SELECT id_transaccion, estado, 'Manual' AS tipo_origen FROM tbl_transaccion_financiera""",
    "borrado_en_cascada__bloqueados": _animals_sql(True),
    "borrado_en_cascada__tbl_animal": _GONE + f"SELECT id_animal, arete FROM in_tbl_animal WHERE {_KEPT}",
    "borrado_en_cascada__tbl_pesaje": _GONE + f"SELECT id_pesaje, id_animal FROM in_tbl_pesaje WHERE {_KEPT}",
    "borrado_en_cascada__tbl_toro_detalle": _GONE
    + f"SELECT id_toro_detalle, id_animal FROM in_tbl_toro_detalle WHERE {_KEPT}",
    "borrado_en_cascada__tbl_toro_inseminacion": _GONE
    + "SELECT id_inseminacion, id_toro_detalle FROM in_tbl_toro_inseminacion "
    f"WHERE id_toro_detalle NOT IN {_GONE_BULLS}",
    "borrado_en_cascada__tbl_ternero_detalle": _GONE
    + f"SELECT id_ternero_detalle, id_animal, {_null_out('id_madre')}, {_null_out('id_padre')} "
    f"FROM in_tbl_ternero_detalle WHERE {_KEPT}",
    "borrado_en_cascada__tbl_alerta": _GONE + f"SELECT id_alerta, id_animal FROM in_tbl_alerta WHERE {_KEPT}",
    "borrado_en_cascada__tbl_auditoria_alerta": _GONE
    + f"SELECT id_auditoria, CASE WHEN id_alerta IN {_GONE_ALERTS} THEN NULL ELSE id_alerta END AS id_alerta, "
    "id_animal FROM in_tbl_auditoria_alerta",
    "borrado_en_cascada__tbl_registro_sanitario_animal": _GONE
    + f"SELECT id_registro_san, id_animal FROM in_tbl_registro_sanitario_animal WHERE {_KEPT}",
    "borrado_en_cascada__manga_bloqueada": """
        SELECT id_manga FROM in_tbl_manga m WHERE id_manga = 5
          AND EXISTS (SELECT 1 FROM in_tbl_movimiento_manga v WHERE v.id_manga_destino = m.id_manga)""",
    "cambio_de_clave__bloqueados": _animals_sql(True, update=True),
    "cambio_de_clave__tbl_animal": _MOVED + f"SELECT {_moved('id_animal')}, arete FROM in_tbl_animal",
    "cambio_de_clave__tbl_pesaje": _MOVED + f"SELECT id_pesaje, {_moved('id_animal')} FROM in_tbl_pesaje",
    "cambio_de_clave__tbl_toro_detalle": _MOVED
    + f"SELECT id_toro_detalle, {_moved('id_animal')} FROM in_tbl_toro_detalle",
    "cambio_de_clave__tbl_ternero_detalle": _MOVED
    + f"SELECT id_ternero_detalle, {_moved('id_animal')}, {_moved('id_madre')}, {_moved('id_padre')} "
    "FROM in_tbl_ternero_detalle",
    "cambio_de_clave__tbl_alerta": _MOVED + f"SELECT id_alerta, {_moved('id_animal')} FROM in_tbl_alerta",
    "cambio_de_clave__tbl_registro_sanitario_animal": _MOVED
    + f"SELECT id_registro_san, {_moved('id_animal')} FROM in_tbl_registro_sanitario_animal",
    "cambio_de_clave__manga_tbl_animal": """
        SELECT id_animal, CASE WHEN id_manga_actual = 5 THEN 1005 ELSE id_manga_actual END AS id_manga_actual
        FROM in_tbl_animal""",
}
