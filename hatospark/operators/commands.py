"""Batch command jobs: a table of requests is checked, split into accepted and
rejected, and turned into new rows and rewritten tables.

Every request carries ``seq``, a unique integer; requests count as applied in
that order.  Keys are assigned to accepted requests only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint
from ..functions.components import least_of_component
from ..functions.ids import assign_ids, last_id
from ..functions.sequence import total_before
from ..functions.text import loose
from ..model import domains as D
from ..model.tables import SIX_DIGITS, TABLES
from .changes import auditar_alertas_alta, auditar_alertas_cambio, scd2
from .quality import fill_defaults, with_generated


def _words(domain) -> str:
    return "(" + ", ".join(f"'{w}'" for w in domain) + ")"


def _first_reason(rules: dict[str, str]) -> Column:
    """The reason of the first broken rule, NULL where none is broken."""
    whens = " ".join(f"WHEN {broken} THEN '{reason}'" for reason, broken in rules.items())
    return F.expr(f"CASE {whens} END")


def too_long(table: str, *columns: str) -> str:
    """Whether a text of a request is longer than its declared column."""
    sizes = {c.name: c.size for c in TABLES[table].columns}
    return " OR ".join(f"char_length({c}) > {sizes[c]}" for c in columns if sizes[c])


def mark_missing(df: DataFrame, column: str, parent: DataFrame, key: str, flag: str) -> DataFrame:
    """Add ``flag``: the column holds a value that is no key of the parent."""
    known = parent.select(F.col(key).alias(column), F.lit(True).alias("_known"))
    return (
        df.join(known, column, "left")
        .withColumn(flag, F.col(column).isNotNull() & F.col("_known").isNull())
        .drop("_known")
    )


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    accepted = df.filter("motivo IS NULL").drop("motivo")
    return accepted, df.filter("motivo IS NOT NULL").select("seq", "motivo")


# -- causes --------------------------------------------------------------------------


def resolver_causas(causa: DataFrame, pedidos: DataFrame) -> dict[str, DataFrame]:
    """Find or create the cause each request names; spelling differences do not count.

    Requests shrink to their distinct causes before anything else is shuffled.
    """
    canonical = reduce(
        lambda acc, word: acc.when(loose("principal") == loose(F.lit(word)), F.lit(word)),
        D.CAUSA_PRINCIPAL[1:],
        F.when(loose("principal") == loose(F.lit(D.CAUSA_PRINCIPAL[0])), F.lit(D.CAUSA_PRINCIPAL[0])),
    )
    asked = pedidos.withColumn("_causa", canonical).withColumn("_k", loose("detalle"))
    valid = asked.filter("_causa IS NOT NULL")
    wanted = valid.groupBy("_causa", "_k").agg(
        F.min("seq").alias("seq"), F.min_by("detalle", "seq").alias("detalle")
    )
    known = (
        causa.select(F.col("causa_principal").alias("_causa"), loose("detalle_causa").alias("_k"), "id_causa")
        .groupBy("_causa", "_k")
        .agg(F.min("id_causa").alias("id_causa"))
    )

    def same(a, b):
        return (F.col(f"{a}._causa") == F.col(f"{b}._causa")) & F.col(f"{a}._k").eqNullSafe(F.col(f"{b}._k"))

    matched = (
        wanted.alias("w")
        .join(known.alias("c"), same("w", "c"), "left")
        .select("w._causa", "w._k", "w.seq", "w.detalle", F.col("c.id_causa").cast("bigint").alias("id_causa"))
    )
    created = assign_ids(matched.filter("id_causa IS NULL").drop("id_causa"), "seq", "id_causa", causa, "id_causa")
    keys = matched.filter("id_causa IS NOT NULL").unionByName(created)
    resolved = (
        valid.alias("v")
        .join(keys.alias("k"), same("v", "k"))
        .select("v.seq", F.col("k.id_causa").alias("id_causa"))
    )
    return {
        "resueltas": resolved,
        "tbl_causa": created.select(
            "id_causa",
            F.col("_causa").alias("causa_principal"),
            F.col("detalle").alias("detalle_causa"),
            F.lit(True).alias("activo"),
        ),
        "rechazadas": asked.filter("_causa IS NULL").select(
            "seq", F.lit("causa principal fuera de dominio").alias("motivo")
        ),
    }


# -- animals ---------------------------------------------------------------------------


#: Requests of a component that one ordered fold decides; of larger ones, the earliest that many at a time.
FOLDED = 8192


def _fold(rows: Column, keys: list[str]) -> Column:
    """The positions (from 1) in ``rows``, sorted by seq, of the requests that get all their keys."""
    none = [F.array().cast("array<string>").alias(k) for k in keys]
    empty = F.struct(*none, F.array().cast("array<int>").alias("won"))

    def step(held, i):
        row = F.get(rows, i - 1)
        free = ~F.array_contains(held[keys[0]], row[keys[0]])
        for k in keys[1:]:
            free = free & ~F.array_contains(held[k], row[k])
        grown = [F.array_append(held[k], row[k]).alias(k) for k in keys]
        return F.when(free, F.struct(*grown, F.array_append(held["won"], i).alias("won"))).otherwise(held)

    return F.aggregate(F.sequence(F.lit(1), F.size(rows)), empty, step, lambda held: held["won"])


def _first_claimants(open_: DataFrame, keys: list[str]) -> DataFrame:
    """The requests that come first for all of their keys."""
    first = open_
    for k in keys:
        least = open_.groupBy(k).agg(F.min("seq").alias(f"_{k}"))
        first = first.join(least, k).filter(F.col("seq") == F.col(f"_{k}"))
    return first.select("seq", *keys)


def _folded(open_: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted requests of whole small components, and of the earliest ones of each large component.

    The earliest requests of a component do not depend on later ones, so a part of it can be decided.
    """
    node = [F.xxhash64(F.lit(i), F.col(k)) for i, k in enumerate(keys)]
    nodes = open_.select(node[0].alias("a"), F.explode(F.array(*node)).alias("b"))
    root = least_of_component(nodes).withColumnRenamed("node", "_node")
    named = open_.withColumn("_node", node[0]).join(root, "_node").drop("_node")
    early = total_before(named, "seq", F.lit(1), "_place", ("root",)).filter(F.col("_place") < FOLDED)
    listed = early.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("seq", *keys))).alias("_rows"))
    won = listed.select("_rows", F.explode(_fold(F.col("_rows"), keys)).alias("_i"))
    return won.select(F.get("_rows", F.col("_i") - 1).alias("r")).select("r.*")


def clashes(requests: DataFrame, keys: list[str]) -> DataFrame | None:
    """``seq`` of the requests that claim a unique key an earlier accepted one holds.

    Only requests that share a key with another are looked at.  In each round the first claimant of all its
    keys wins and those it beats are out, which settles keys that very many claim.  What is left
    falls into connected components, decided by one ordered fold each; of a component of more than ``FOLDED``
    requests a round decides the earliest ``FOLDED``, so a component of n takes at most n / ``FOLDED`` rounds.
    None where no key is claimed twice.
    """
    claims = requests.select("seq", *keys)
    shared = [
        claims.join(claims.groupBy(k).count().filter("count > 1").select(k), k, "left_semi").select("seq", *keys)
        for k in keys
    ]
    open_ = checkpoint(reduce(DataFrame.unionByName, shared).dropDuplicates(["seq"]))
    lost = []
    while not open_.isEmpty():
        for accept in (_first_claimants, _folded):
            won = checkpoint(accept(open_, keys))
            rest = open_.join(won.select("seq"), "seq", "left_anti")
            beaten = [rest.join(won.select(k), k, "left_semi").select("seq") for k in keys]
            out = checkpoint(reduce(DataFrame.union, beaten).distinct())
            lost.append(out)
            open_ = checkpoint(rest.join(out, "seq", "left_anti"))
            if open_.isEmpty():
                break
    return reduce(DataFrame.union, lost) if lost else None


def _details(accepted: DataFrame, table: DataFrame, name: str, as_of: str, run_ts: str) -> DataFrame:
    """New detail rows with their keys and the declared defaults."""
    model = TABLES[name]
    numbered = assign_ids(accepted, "seq", model.key, table, model.key)
    return fill_defaults(numbered.drop("seq"), model, as_of, run_ts)


def _journal(rows: DataFrame, action: str, json: str) -> DataFrame:
    return rows.selectExpr(
        "id_usuario",
        f"'{action}' AS accion",
        "'tbl_animal' AS tabla_afectada",
        "CAST(id_animal AS STRING) AS id_registro",
        f"{json} AS detalle",
    )


def alta_animales(pedidos: DataFrame, tablas, as_of: str, run_ts: str) -> dict[str, DataFrame]:
    """Register animals with their first detail row.

    ``tablas`` maps table names to the current animals, details and catalogues.
    """
    animal = tablas["tbl_animal"]
    df = pedidos.withColumn("_arete", loose("arete"))
    for column, table in (
        ("id_raza", "tbl_raza"),
        ("id_manga", "tbl_manga"),
        ("id_procedencia", "tbl_procedencia"),
        ("id_madre", "tbl_animal"),
        ("id_padre", "tbl_animal"),
        ("id_usuario", "tbl_usuario"),
    ):
        df = mark_missing(df, column, tablas[table], TABLES[table].key, f"_sin_{column}")
    held = animal.select(loose("arete").alias("_arete")).distinct().withColumn("_con_arete", F.lit(True))
    codes = animal.select("trazabilidad").distinct().withColumn("_con_codigo", F.lit(True))
    df = df.join(held, "_arete", "left").join(codes, "trazabilidad", "left")
    mandatory = ("arete", "trazabilidad", "sexo", "id_raza", "fecha_nac")
    rules = {
        "Tipo de animal inválido: use Vaca, Toro o Ternero": f"tipo IS NULL OR tipo NOT IN {_words(D.TIPO_ANIMAL)}",
        "dato obligatorio ausente": " OR ".join(f"{c} IS NULL" for c in mandatory),
        "sexo inválido": f"sexo NOT IN {_words(D.SEXO)}",
        "trazabilidad inválida": f"NOT trazabilidad RLIKE '{SIX_DIGITS}'",
        "propósito inválido": f"tipo = 'Toro' AND proposito NOT IN {_words(D.TIPO_USO)}",
        "raza inexistente": "_sin_id_raza",
        "manga inexistente": "_sin_id_manga",
        "procedencia inexistente": "_sin_id_procedencia",
        "padre o madre inexistente": "tipo = 'Ternero' AND (_sin_id_madre OR _sin_id_padre)",
        "usuario inexistente": "_sin_id_usuario",
        "texto demasiado largo": too_long("tbl_animal", "arete", "trazabilidad"),
        "peso fuera de rango": (
            "peso IS NOT NULL AND (try_cast(peso AS DECIMAL(7,2)) IS NULL "
            "OR tipo = 'Ternero' AND try_cast(peso AS DECIMAL(6,2)) IS NULL)"
        ),
        "arete duplicado": "_con_arete",
        "trazabilidad duplicada": "_con_codigo",
    }
    df = df.withColumn("motivo", _first_reason(rules)).select(*pedidos.columns, "_arete", "motivo")
    ready, rejected = _split(df)
    lost = clashes(ready, ["_arete", "trazabilidad"])
    if lost is not None:
        reason = F.lit("arete o trazabilidad duplicados en el lote").alias("motivo")
        rejected = rejected.unionByName(lost.select("seq", reason))
        ready = ready.join(lost, "seq", "left_anti")
    accepted = assign_ids(ready, "seq", "id_animal", animal, "id_animal")

    def of(kind, *columns):
        return accepted.filter(f"tipo = '{kind}'").selectExpr("seq", "id_animal", *columns)

    rows = accepted.selectExpr(
        "id_animal",
        "id_procedencia",
        "id_raza",
        "id_manga AS id_manga_actual",
        "trazabilidad",
        "tipo AS tipo_animal",
        "sexo",
        "arete",
        "fecha_nac AS fecha_nacimiento",
        "peso AS peso_actual_kg",
    )
    bull = of("Toro", "coalesce(proposito, 'Semental') AS tipo_uso", "id_usuario AS id_usuario_registro")
    calf = of("Ternero", "id_madre", "id_padre", "CAST(peso AS DECIMAL(6,2)) AS peso_nacimiento_kg")
    new = {"tbl_vaca_detalle": of("Vaca"), "tbl_toro_detalle": bull, "tbl_ternero_detalle": calf}
    return {
        "tbl_animal": fill_defaults(rows, TABLES["tbl_animal"], as_of, run_ts),
        **{name: _details(df, tablas[name], name, as_of, run_ts) for name, df in new.items()},
        "tbl_bitacora": _journal(
            accepted, "INSERT", "to_json(named_struct('tipo', tipo, 'arete', arete))"
        ),
        "rechazadas": rejected,
    }


def promover_terneros(pedidos: DataFrame, tablas, as_of: str, run_ts: str) -> dict[str, DataFrame]:
    """Turn calves into cows or bulls and open their new detail row."""
    animal = tablas["tbl_animal"]
    known = animal.select("id_animal", "sexo", F.lit(True).alias("_known"))
    rules = {
        "animal inexistente": "_known IS NULL",
        "Tipo de animal inválido: use Vaca, Toro o Ternero": (
            f"nuevo_tipo IS NULL OR nuevo_tipo NOT IN {_words(D.TIPO_ANIMAL)}"
        ),
        "Sexo del animal incompatible con la promoción solicitada": (
            "(nuevo_tipo = 'Vaca' AND sexo <> 'F') OR (nuevo_tipo = 'Toro' AND sexo <> 'M')"
        ),
        "propósito inválido": f"nuevo_tipo <> 'Vaca' AND proposito NOT IN {_words(D.TIPO_USO)}",
        "usuario inexistente": "_sin_usuario",
    }
    checked = mark_missing(pedidos, "id_usuario", tablas["tbl_usuario"], "id_usuario", "_sin_usuario")
    checked = checked.join(known, "id_animal", "left").withColumn("motivo", _first_reason(rules))
    accepted, rejected = _split(checked.select(*pedidos.columns, "motivo"))
    # Spread by ``seq``: the join before left all requests for an animal in one task.
    spread = accepted.select("id_animal", "nuevo_tipo", "seq").repartition("seq")
    last = spread.groupBy("id_animal").agg(F.max_by("nuevo_tipo", "seq").alias("_tipo"))
    calf = tablas["tbl_ternero_detalle"]
    closes = F.col("es_vigente") & F.col("_tipo").isNotNull()
    cows = accepted.filter("nuevo_tipo = 'Vaca'").select("seq", "id_animal")
    bulls = accepted.filter("nuevo_tipo <> 'Vaca'").selectExpr(
        "seq",
        "id_animal",
        "coalesce(proposito, 'Semental') AS tipo_uso",
        "id_usuario AS id_usuario_registro",
    )

    def opened(name, rows):
        new = _details(rows, tablas[name], name, as_of, run_ts)
        return scd2(tablas[name], new.select(tablas[name].columns), TABLES[name].key)

    return {
        "tbl_animal": animal.join(last, "id_animal", "left")
        .withColumn("tipo_animal", F.coalesce("_tipo", "tipo_animal"))
        .select(animal.columns),
        "tbl_ternero_detalle": calf.join(last, "id_animal", "left")
        .withColumns(
            {
                "fecha_fin": F.when(closes, F.lit(as_of).cast("date")).otherwise(F.col("fecha_fin")),
                "es_vigente": F.col("es_vigente") & ~closes,
            }
        )
        .select(calf.columns),
        "tbl_vaca_detalle": opened("tbl_vaca_detalle", cows),
        "tbl_toro_detalle": opened("tbl_toro_detalle", bulls),
        "tbl_bitacora": _journal(
            accepted, "PROMOTE", "to_json(named_struct('nuevo_tipo', nuevo_tipo))"
        ),
        "rechazadas": rejected,
    }


# -- alerts ----------------------------------------------------------------------------


def crear_alertas(
    pedidos: DataFrame,
    alerta: DataFrame,
    animal: DataFrame,
    usuario: DataFrame,
    user: str,
    as_of: str,
    run_ts: str,
) -> dict[str, DataFrame]:
    """Append alerts and their audit rows."""
    rules = {
        "dato obligatorio ausente": "tipo IS NULL OR fecha_prog IS NULL OR enviar_correo IS NULL",
        "módulo inválido": f"modulo IS NULL OR modulo NOT IN {_words(D.MODULO_ALERTA)}",
        "prioridad inválida": f"prioridad IS NULL OR prioridad NOT IN {_words(D.PRIORIDAD)}",
        "animal inexistente": "_sin_animal",
        "usuario inexistente": "_sin_usuario",
        "texto demasiado largo": too_long("tbl_alerta", "tipo"),
    }
    checked = mark_missing(pedidos, "id_animal", animal, "id_animal", "_sin_animal")
    checked = mark_missing(checked, "id_usuario", usuario, "id_usuario", "_sin_usuario")
    accepted, rejected = _split(checked.withColumn("motivo", _first_reason(rules)))
    numbered = assign_ids(accepted, "seq", "id_alerta", alerta, "id_alerta").selectExpr(
        "id_alerta",
        "modulo",
        "id_animal",
        "tipo",
        "descripcion",
        "prioridad",
        "fecha_prog AS fecha_programada",
        "enviar_correo",
        "id_usuario AS id_usuario_atiende",
    )
    new = fill_defaults(numbered, TABLES["tbl_alerta"], as_of, run_ts)
    return {
        "tbl_alerta": new,
        "tbl_auditoria_alerta": auditar_alertas_alta(new, user, run_ts),
        "rechazadas": rejected,
    }


def atender_alertas(
    pedidos: DataFrame, alerta: DataFrame, usuario: DataFrame, user: str, run_ts: str
) -> dict[str, DataFrame]:
    """Attend pending alerts; the first valid request counts, others find the alert closed."""
    checked = mark_missing(pedidos, "id_usuario", usuario, "id_usuario", "_sin_usuario")
    checked = checked.withColumn("motivo", _first_reason({"usuario inexistente": "_sin_usuario"}))
    accepted, rejected = _split(checked)
    first = accepted.groupBy("id_alerta").agg(
        F.min_by(F.struct("id_usuario"), "seq").alias("_por")
    )
    hit = F.col("_por").isNotNull() & (F.col("estado") == "Pendiente")
    now = F.lit(run_ts).cast("timestamp_ntz")
    after = (
        alerta.join(first, "id_alerta", "left")
        .withColumns(
            {
                "fecha_atendida": F.when(hit, now).otherwise(F.col("fecha_atendida")),
                "notificacion_vista": hit | F.col("notificacion_vista"),
                "id_usuario_atiende": F.when(hit, F.col("_por.id_usuario")).otherwise(
                    F.col("id_usuario_atiende")
                ),
                "estado": F.when(hit, F.lit("Atendida")).otherwise(F.col("estado")),
            }
        )
        .select(alerta.columns)
    )
    return {
        "tbl_alerta": after,
        "tbl_auditoria_alerta": auditar_alertas_cambio(alerta, after, user, run_ts),
        "rechazadas": rejected,
    }


# -- health ----------------------------------------------------------------------------

HEADER = (
    "categoria",
    "sub_tipo",
    "proposito",
    "id_producto",
    "dosis_valor",
    "dosis_unidad",
    "fecha_aplicacion",
    "intervalo_dias",
    "duracion_dias",
    "id_causa",
    "notas",
    "id_veterinario",
    "id_usuario",
)
_HEADER_RULES = {
    "categoría inválida": f"categoria IS NULL OR categoria NOT IN {_words(D.CATEGORIA_SANITARIA)}",
    "fecha de aplicación ausente": "fecha_aplicacion IS NULL",
    "propósito inválido": f"proposito NOT IN {_words(D.PROPOSITO_SANITARIO)}",
    "unidad de dosis inválida": f"dosis_unidad NOT IN {_words(D.DOSIS_UNIDAD)}",
    "repetición inválida": f"repeticion NOT IN {_words(D.REPETICION)}",
    "producto inexistente": "_sin_id_producto",
    "causa inexistente": "_sin_id_causa",
    "veterinario inexistente": "_sin_id_veterinario",
    "usuario inexistente": "_sin_id_usuario",
    "cronograma inválido": "(cronograma_json IS NOT NULL AND _fechas IS NULL) "
    "OR exists(_fechas, f -> f IS NULL)",
}


def _with_header_checks(pedidos: DataFrame, tablas) -> DataFrame:
    df = pedidos.withColumn(
        "_fechas",
        F.expr("transform(from_json(cronograma_json, 'array<string>'), f -> try_cast(f AS date))"),
    )
    for column, table in (
        ("id_producto", "tbl_producto_sanitario"),
        ("id_causa", "tbl_causa"),
        ("id_veterinario", "tbl_colaborador"),
        ("id_usuario", "tbl_usuario"),
    ):
        df = mark_missing(df, column, tablas[table], TABLES[table].key, f"_sin_{column}")
    return df


def _health_tables(numbered, treated, alerts, kind, tablas, as_of, run_ts, user):
    """The tables both health jobs write.

    ``numbered`` holds the accepted requests with ``id_registro_san`` and the
    dates ``_fechas``; ``treated`` one row per animal with its place in the
    request; ``alerts`` those rows with the first alert key of the request.
    """
    header = numbered.selectExpr(
        "id_registro_san",
        f"'{kind}' AS tipo_aplicacion",
        "coalesce(repeticion, 'Única') AS repeticion",
        *HEADER,
    )
    opening = "Requiere aplicación programada de " if kind == "Individual" else "Aplicación masiva programada de "
    new_alerts = alerts.selectExpr(
        "id_animal",
        "categoria",
        "sub_tipo",
        "_antes",
        "_lugar",
        "size(_fechas) AS _n",
        "posexplode(_fechas) AS (_i, fecha_programada)",
    ).select(
        (last_id(tablas["tbl_alerta"], "id_alerta") + F.expr("_antes + _lugar * _n + _i + 1")).alias("id_alerta"),
        F.lit("Sanidad").alias("modulo"),
        "id_animal",
        F.concat(F.lit("Próxima dosis: "), "categoria").alias("tipo"),
        F.concat(F.lit(opening), F.coalesce("sub_tipo", F.lit("tratamiento"))).alias("descripcion"),
        F.lit("Normal").alias("prioridad"),
        "fecha_programada",
    )
    new_alerts = fill_defaults(new_alerts, TABLES["tbl_alerta"], as_of, run_ts)
    return {
        "tbl_registro_sanitario": fill_defaults(header, TABLES["tbl_registro_sanitario"], as_of, run_ts),
        "tbl_registro_sanitario_animal": treated.selectExpr(
            "id_registro_san",
            "id_animal",
            "'Aplicado' AS estado_aplicacion",
            f"CAST('{run_ts}' AS TIMESTAMP_NTZ) AS fecha_real_aplicacion",
        ),
        "tbl_programacion_sanitaria": numbered.selectExpr(
            "id_registro_san", "explode(_fechas) AS fecha_programada"
        ).selectExpr(
            "id_registro_san",
            "CAST(fecha_programada AS TIMESTAMP_NTZ) AS fecha_programada",
            "'Pendiente' AS estado",
        ),
        "tbl_alerta": new_alerts,
        "tbl_auditoria_alerta": auditar_alertas_alta(new_alerts, user, run_ts),
    }


def sanidad_individual(pedidos: DataFrame, tablas, user: str, as_of: str, run_ts: str) -> dict[str, DataFrame]:
    """Health events for the animals each request lists, with schedule, alerts and udder quarters."""
    animal = tablas["tbl_animal"]
    df = _with_header_checks(pedidos, tablas).withColumns(
        {
            "_animales": F.expr("from_json(animales_json, 'array<bigint>')"),
            "_cuartos": F.expr(
                "CASE WHEN categoria = 'Mastitis' THEN from_json(mastitis_json, "
                "'array<struct<id_animal:bigint,ad:string,pd:string,ai:string,pi:string>>') END"
            ),
        }
    )
    named = df.selectExpr("seq", "explode(concat(coalesce(_animales, array()), "
                          "coalesce(transform(_cuartos, c -> c.id_animal), array()))) AS id_animal")
    strangers = (
        named.join(animal.select("id_animal"), "id_animal", "left_anti")
        .select("seq")
        .distinct()
        .withColumn("_ajenos", F.lit(True))
    )
    quarters = " OR ".join(f"c.{q} IS NULL OR c.{q} NOT IN {_words(D.CUARTO)}" for q in ("ad", "pd", "ai", "pi"))
    rules = {
        **_HEADER_RULES,
        "lista de animales inválida": "animales_json IS NOT NULL AND _animales IS NULL",
        "animal repetido": "size(array_distinct(_animales)) < size(_animales)",
        "animal inexistente": "_ajenos",
        "cuartos inválidos": (
            "categoria = 'Mastitis' AND mastitis_json IS NOT NULL "
            "AND (_cuartos IS NULL OR exists(_cuartos, c -> c IS NULL OR c.id_animal IS NULL))"
        ),
        "cuarto inválido": f"exists(_cuartos, c -> {quarters})",
    }
    checked = df.join(strangers, "seq", "left").withColumn("motivo", _first_reason(rules))
    accepted, rejected = _split(checked)
    # Only narrow rows are sorted for numbering; the lists join them afterwards.
    load = F.expr("coalesce(size(_animales), 0) * coalesce(size(_fechas), 0)").cast("bigint")
    narrow = total_before(accepted.select("seq", load.alias("_n")), "seq", F.col("_n"), "_antes")
    narrow = assign_ids(
        narrow.drop("_n"), "seq", "id_registro_san", tablas["tbl_registro_sanitario"], "id_registro_san"
    )
    numbered = accepted.join(narrow, "seq")
    treated = numbered.selectExpr(
        "id_registro_san",
        "categoria",
        "sub_tipo",
        "_fechas",
        "_antes",
        "posexplode(_animales) AS (_lugar, id_animal)",
    )
    out = _health_tables(numbered, treated, treated, "Individual", tablas, as_of, run_ts, user)
    out["tbl_mastitis_cuartos"] = numbered.selectExpr("id_registro_san", "explode(_cuartos) AS c").selectExpr(
        "id_registro_san",
        "c.id_animal AS id_animal",
        *(f"c.{q} AS cuarto_{q}" for q in ("ad", "pd", "ai", "pi")),
        "true AS en_tratamiento",
    )
    return {**out, "rechazadas": rejected}


def sanidad_masiva(pedidos: DataFrame, tablas, user: str, as_of: str, run_ts: str) -> dict[str, DataFrame]:
    """Health events for all active animals of a pen."""
    active = tablas["tbl_animal"].filter("estado_animal = 'Activo' AND id_manga_actual IS NOT NULL").select(
        F.col("id_manga_actual").alias("id_manga"), "id_animal"
    )
    heads = active.groupBy("id_manga").agg(F.count("*").alias("afectados"))
    rules = {
        "La manga seleccionada está vacía o no tiene animales activos.": "afectados IS NULL",
        **_HEADER_RULES,
    }
    checked = (
        _with_header_checks(pedidos, tablas)
        .join(heads, "id_manga", "left")
        .withColumn("motivo", _first_reason(rules))
    )
    accepted, rejected = _split(checked)
    numbered = assign_ids(
        accepted, "seq", "id_registro_san", tablas["tbl_registro_sanitario"], "id_registro_san"
    )
    load = F.col("afectados") * F.expr("coalesce(size(_fechas), 0)")
    numbered = total_before(numbered, "seq", load, "_antes")
    placed = total_before(active, "id_animal", F.lit(1), "_lugar", keys=("id_manga",))
    treated = placed.join(
        numbered.select("id_manga", "id_registro_san", "categoria", "sub_tipo", "_fechas", "_antes"), "id_manga"
    )
    out = _health_tables(numbered, treated, treated, "Masivo", tablas, as_of, run_ts, user)
    out["resumen"] = numbered.select("seq", "id_registro_san", "afectados")
    return {**out, "rechazadas": rejected}


# -- finance ---------------------------------------------------------------------------


def _income(rows: DataFrame, day: str, concept: str, text: str, amount: str, origin: str) -> DataFrame:
    return rows.selectExpr(
        "id_transaccion",
        "'ingreso' AS categoria",
        f"{day} AS fecha_transaccion",
        f"{concept} AS concepto",
        f"{text} AS descripcion",
        f"CAST({amount} AS DECIMAL(12,2)) AS monto",
        "'ejecutado' AS estado",
        f"'{origin}' AS tipo_origen",
        "id_usuario",
    )


def ingreso_venta_animal(
    pedidos: DataFrame, baja: DataFrame, animal: DataFrame, transaccion: DataFrame, usuario: DataFrame
) -> dict[str, DataFrame]:
    """Income of sold animals: a ledger entry and its detail share one key."""
    exits = baja.select("id_baja", "id_animal", "fecha_baja", "comprador").join(
        animal.select("id_animal", "arete"), "id_animal"
    )
    rules = {
        "baja inexistente": "arete IS NULL",
        "precio inválido": "precio IS NULL OR precio < 0",
        "comisión ausente": "comision_pct IS NULL",
        "usuario inexistente": "_sin_usuario",
        "importe fuera de rango": "try_cast(precio AS DECIMAL(12,2)) IS NULL",
    }
    checked = mark_missing(pedidos, "id_usuario", usuario, "id_usuario", "_sin_usuario")
    checked = checked.join(exits, "id_baja", "left").withColumn("motivo", _first_reason(rules))
    accepted, rejected = _split(checked)
    numbered = assign_ids(accepted, "seq", "id_transaccion", transaccion, "id_transaccion")
    detail = numbered.selectExpr("id_transaccion", "id_baja", "precio AS precio_acordado", "comision_pct", "notas")
    return {
        "tbl_transaccion_financiera": _income(
            numbered,
            "fecha_baja",
            "concat('Venta animal: ', arete)",
            "concat('Comprador: ', coalesce(comprador, 'N/A'))",
            "precio",
            "Venta Animal",
        ),
        "tbl_transaccion_animal": with_generated(detail, TABLES["tbl_transaccion_animal"]),
        "rechazadas": rejected,
    }


def period_totals(periods: DataFrame, daily: DataFrame) -> DataFrame:
    """Sum daily amounts over closed date ranges with equality joins only.

    The running total of all days from the first to the day after the last is a table of one row per
    calendar day; a range is the difference of two of its rows. ``daily`` has one row per ``dia``
    with ``litros``.
    """
    first, last = (daily.select(f("dia")).scalar() for f in (F.min, F.max))
    days = daily.agg(F.min("dia").alias("a"), F.max("dia").alias("b")).selectExpr(
        "explode(sequence(a, date_add(b, 1))) AS dia"
    )
    # One row per calendar day, however many animals and years of milk there are.
    before = Window.orderBy("dia").rowsBetween(Window.unboundedPreceding, -1)
    running = days.join(daily, "dia", "left").select(
        "dia", F.coalesce(F.sum("litros").over(before), F.lit(0)).alias("antes")
    )

    def within(day):
        return F.greatest(first, F.least(F.date_add(last, 1), day))

    ends = periods.filter("fecha_inicio <= fecha_fin").select(
        "seq", within(F.col("fecha_inicio")).alias("desde"), within(F.date_add("fecha_fin", 1)).alias("hasta")
    )
    start = running.select(F.col("dia").alias("desde"), F.col("antes").alias("_desde"))
    end = running.select(F.col("dia").alias("hasta"), F.col("antes").alias("_hasta"))
    return (
        ends.join(start, "desde").join(end, "hasta").select("seq", (F.col("_hasta") - F.col("_desde")).alias("litros"))
    )


def liquidar_leche(
    pedidos: DataFrame, leche: DataFrame, transaccion: DataFrame, usuario: DataFrame
) -> dict[str, DataFrame]:
    """Settle the milk of a period: net income entry and settlement detail.

    Litres and amounts that do not fit their columns refuse their own request only.
    """
    daily = leche.groupBy(F.col("fecha_ordeno").alias("dia")).agg(F.sum("total_litros").alias("litros"))
    df = (
        mark_missing(pedidos, "id_usuario", usuario, "id_usuario", "_sin_usuario")
        .join(period_totals(pedidos, daily), "seq", "left")
        .withColumn("total_litros", F.expr("try_cast(coalesce(litros, 0) AS DECIMAL(10,2))"))
        .withColumn("_neto", F.expr("try_cast(total_litros * precio_litro - descuentos AS DECIMAL(12,2))"))
    )
    rules = {
        "litros fuera de rango": "total_litros IS NULL",
        "No hay registros de producción en el período indicado": "total_litros = 0",
        "precio o descuentos ausentes": "precio_litro IS NULL OR descuentos IS NULL",
        "importe fuera de rango": (
            "_neto IS NULL OR try_cast(total_litros * precio_litro AS DECIMAL(12,2)) IS NULL"
        ),
        "ingreso neto negativo": "_neto < 0",
        "usuario inexistente": "_sin_usuario",
    }
    accepted, rejected = _split(df.withColumn("motivo", _first_reason(rules)))
    numbered = assign_ids(accepted, "seq", "id_transaccion", transaccion, "id_transaccion")
    detail = numbered.select(
        "id_transaccion",
        "fecha_inicio",
        "fecha_fin",
        "total_litros",
        "precio_litro",
        "descuentos",
        "comprador",
        "notas",
    )
    return {
        "tbl_transaccion_financiera": _income(
            numbered,
            "fecha_fin",
            "concat('Liquidación leche: ', CAST(fecha_inicio AS STRING), ' → ', CAST(fecha_fin AS STRING))",
            "concat(CAST(total_litros AS STRING), ' lts × $', CAST(precio_litro AS STRING), "
            "' | Comprador: ', coalesce(comprador, 'N/A'))",
            "_neto",
            "Ingreso Leche",
        ),
        "tbl_transaccion_leche": with_generated(detail, TABLES["tbl_transaccion_leche"]),
        "rechazadas": rejected,
    }
