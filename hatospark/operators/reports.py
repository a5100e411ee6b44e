"""The twelve read queries.  Each takes the tables it reads and, where the result
depends on the day, the business date ``as_of`` (ISO text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import left_join_many
from ..model.domains import PRIORIDAD


def _date(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def percent(part: Column, whole: Column, scale: int) -> Column:
    """Share in percent, divided as decimals so that ties round away from zero; NULL over 0."""
    share = part.cast("decimal(20,0)") * 100 / F.nullif(whole.cast("decimal(20,0)"), F.lit(0))
    return F.round(share, scale).cast("double")


def animal_completo(
    animal: DataFrame,
    raza: DataFrame,
    manga: DataFrame,
    procedencia: DataFrame,
    vaca: DataFrame,
    toro: DataFrame,
    ternero: DataFrame,
    as_of: str,
) -> DataFrame:
    """One row per animal (and current detail row) with catalogues and full months of age."""
    df = (
        animal.select(
            "id_animal",
            "arete",
            "trazabilidad",
            "tipo_animal",
            "sexo",
            "id_raza",
            "id_manga_actual",
            "id_procedencia",
            "fecha_nacimiento",
            "peso_actual_kg",
            "estado_animal",
        )
        .join(raza.select("id_raza", "nombre_raza", F.col("proposito").alias("proposito_raza")), "id_raza", "left")
        .join(
            manga.select(
                F.col("id_manga").alias("id_manga_actual"), F.col("nombre").alias("manga_actual"), "numero_manga"
            ),
            "id_manga_actual",
            "left",
        )
        .join(
            procedencia.select("id_procedencia", F.col("nombre").alias("procedencia")),
            "id_procedencia",
            "left",
        )
    )
    details = (
        (vaca, "id_vaca_detalle", ("estado_ordeno", "estado_reproductivo")),
        (toro, "id_toro_detalle", ("tipo_uso", "activo_reproduccion", "libido_evaluacion")),
        (ternero, "id_ternero_detalle", ("estado_lactancia", "peso_nacimiento_kg", "peso_destete_kg")),
    )
    for detail, key, columns in details:
        current = detail.filter("es_vigente").select("id_animal", key, *columns)
        df = left_join_many(df, current, "id_animal", key).drop(key)
    return df.select(
        "id_animal",
        "arete",
        "trazabilidad",
        "tipo_animal",
        "sexo",
        "nombre_raza",
        "proposito_raza",
        "manga_actual",
        "numero_manga",
        "procedencia",
        "fecha_nacimiento",
        F.timestamp_diff("MONTH", F.col("fecha_nacimiento").cast("timestamp"), _date(as_of).cast("timestamp"))
        .cast("bigint")
        .alias("edad_meses"),
        "peso_actual_kg",
        "estado_animal",
        *(c for _, _, columns in details for c in columns),
    )


def inventario_mangas(manga: DataFrame, animal: DataFrame) -> DataFrame:
    """Pens with head count and occupancy; the count happens before the join."""
    heads = (
        animal.filter(~F.col("estado_animal").isin("Fallecido", "Vendido"))
        .filter("id_manga_actual IS NOT NULL")
        .groupBy(F.col("id_manga_actual").alias("id_manga"))
        .agg(F.count("id_animal").alias("cabezas"))
    )
    return inventario(manga, heads)


def inventario(manga: DataFrame, heads: DataFrame) -> DataFrame:
    """Pens with their ``cabezas`` of ``heads`` (one row per pen that has any) and occupancy."""
    count = F.coalesce("cabezas", F.lit(0)).cast("bigint")
    return manga.join(heads, "id_manga", "left").select(
        "id_manga",
        "numero_manga",
        "nombre",
        "funcion",
        "capacidad_max",
        count.alias("cantidad_actual"),
        percent(count, F.col("capacidad_max"), 1).alias("pct_ocupacion"),
    )


def produccion_reciente(
    leche: DataFrame, animal: DataFrame, raza: DataFrame, manga: DataFrame, as_of: str
) -> DataFrame:
    """Milk records of the last 30 days, newest first."""
    return (
        leche.filter(F.col("fecha_ordeno") >= F.date_sub(_date(as_of), 30))
        .select("id_animal", "fecha_ordeno", "litros_manana", "litros_tarde", "total_litros")
        .join(animal.select("id_animal", "arete", "id_raza", "id_manga_actual"), "id_animal")
        .join(raza.select("id_raza", "nombre_raza"), "id_raza")
        .join(
            manga.select(F.col("id_manga").alias("id_manga_actual"), F.col("nombre").alias("manga")),
            "id_manga_actual",
            "left",
        )
        .select(
            "id_animal",
            "arete",
            "nombre_raza",
            "manga",
            "fecha_ordeno",
            "litros_manana",
            "litros_tarde",
            "total_litros",
        )
        .orderBy(F.desc("fecha_ordeno"), "id_animal")
    )


def alertas_pendientes(alerta: DataFrame, animal: DataFrame, usuario: DataFrame) -> DataFrame:
    """Pending alerts by priority (unknown first) and date."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORIDAD)), F.col("prioridad")), F.lit(0))
    return (
        alerta.filter("estado = 'Pendiente'")
        .join(
            animal.select("id_animal", F.col("arete").alias("arete_animal"), "tipo_animal", "estado_animal"),
            "id_animal",
            "left",
        )
        .join(
            usuario.select(
                F.col("id_usuario").alias("id_usuario_atiende"),
                F.col("nombre_completo").alias("usuario_asignado"),
            ),
            "id_usuario_atiende",
            "left",
        )
        .orderBy(rank, "fecha_programada", "id_alerta")
        .select(
            "id_alerta",
            "modulo",
            "tipo",
            "descripcion",
            "prioridad",
            "fecha_programada",
            "enviar_correo",
            "correo_enviado",
            "notificacion_vista",
            "arete_animal",
            "tipo_animal",
            "estado_animal",
            "usuario_asignado",
        )
    )


def mortalidad(
    muerte: DataFrame, animal: DataFrame, raza: DataFrame, causa: DataFrame, usuario: DataFrame
) -> DataFrame:
    """Deaths with animal, breed, cause and registrar, newest first."""
    return (
        muerte.join(animal.select("id_animal", "arete", "tipo_animal", "id_raza"), "id_animal")
        .join(raza.select("id_raza", "nombre_raza"), "id_raza")
        .join(causa.select("id_causa", "causa_principal", "detalle_causa"), "id_causa")
        .join(
            usuario.select("id_usuario", F.col("nombre_completo").alias("registrado_por")),
            "id_usuario",
            "left",
        )
        .select(
            "id_mortalidad",
            "arete",
            "tipo_animal",
            "nombre_raza",
            "fecha_muerte",
            "causa_principal",
            "detalle_causa",
            "observacion",
            "registrado_por",
        )
        .orderBy(F.desc("fecha_muerte"), "id_mortalidad")
    )


def stock_bajo(insumo: DataFrame) -> DataFrame:
    """Active supplies at or under their minimum, worst first."""
    return (
        insumo.filter("activo AND stock_actual <= stock_minimo")
        .select(
            "id_insumo",
            "nombre",
            "unidad",
            "stock_actual",
            "stock_minimo",
            F.round(F.col("stock_actual") - F.col("stock_minimo"), 2).cast("decimal(11,2)").alias("diferencia"),
        )
        .orderBy("diferencia", "id_insumo")
    )


def auditoria_alertas(auditoria: DataFrame, animal: DataFrame) -> DataFrame:
    """Alert audit with ear tag, newest first."""
    return (
        auditoria.join(
            animal.select("id_animal", F.col("arete").alias("arete_animal")), "id_animal", "left"
        )
        .select(
            "id_auditoria",
            "id_alerta",
            "modulo",
            "tipo",
            "prioridad",
            "fecha_programada",
            "estado_anterior",
            "estado_nuevo",
            "accion_auditoria",
            "fecha_auditoria",
            "usuario_auditor",
            "arete_animal",
        )
        .orderBy(F.desc("fecha_auditoria"), "id_auditoria")
    )


def resumen_financiero_mensual(transaccion: DataFrame) -> DataFrame:
    """Income, expense and balance per month, newest first."""
    income = F.when(F.col("categoria") == "ingreso", F.col("monto")).otherwise(0)
    expense = F.when(F.col("categoria") == "gasto", F.col("monto")).otherwise(0)

    def total(value):
        return F.sum(value.cast("decimal(36,2)")).cast("decimal(38,2)")

    return (
        transaccion.groupBy(
            F.year("fecha_transaccion").cast("bigint").alias("anio"),
            F.month("fecha_transaccion").cast("bigint").alias("mes"),
        )
        .agg(
            total(income).alias("total_ingresos"),
            total(expense).alias("total_gastos"),
            total(income - expense).alias("balance"),
        )
        .orderBy(F.desc("anio"), F.desc("mes"))
    )


def expediente_sanitario(
    tratado: DataFrame,
    registro: DataFrame,
    animal: DataFrame,
    producto: DataFrame,
    causa: DataFrame,
    colaborador: DataFrame,
    programacion: DataFrame,
) -> DataFrame:
    """Treated animals, one row per pending dose of their event (or one without).

    Catalogues and doses join the events first: there are fewer events than
    treated animals.
    """
    event = (
        registro.select(
            "id_registro_san",
            "fecha_aplicacion",
            F.col("categoria").alias("tipo_registro"),
            "dosis_valor",
            "dosis_unidad",
            "id_producto",
            "id_causa",
            "id_veterinario",
        )
        .join(producto.select("id_producto", F.col("nombre").alias("producto")), "id_producto", "left")
        .join(causa.select("id_causa", "causa_principal", "detalle_causa"), "id_causa", "left")
        .join(
            colaborador.select(
                F.col("id_colaborador").alias("id_veterinario"),
                F.col("nombre").alias("veterinario_responsable"),
            ),
            "id_veterinario",
            "left",
        )
        .select(
            "id_registro_san",
            "fecha_aplicacion",
            "tipo_registro",
            F.concat(
                F.coalesce("detalle_causa", "causa_principal", F.lit("Sin diagnóstico")),
                F.lit(" — "),
                F.coalesce("producto", F.lit("Sin producto")),
            ).alias("detalle_tratamiento"),
            F.concat(F.col("dosis_valor").cast("string"), F.lit(" "), "dosis_unidad").alias("dosis_aplicada"),
            "veterinario_responsable",
        )
    )
    pending = programacion.filter("estado = 'Pendiente'").select(
        "id_registro_san", "id_programacion", F.col("fecha_programada").alias("proxima_dosis_revision")
    )
    event = left_join_many(event, pending, "id_registro_san", "id_programacion")
    return (
        tratado.select("id_registro_san", "id_animal", "estado_aplicacion")
        .join(event, "id_registro_san")
        .join(animal.select("id_animal", "arete"), "id_animal")
        .select(
            "id_animal",
            "arete",
            "fecha_aplicacion",
            "tipo_registro",
            "detalle_tratamiento",
            "dosis_aplicada",
            "veterinario_responsable",
            "proxima_dosis_revision",
            "id_registro_san",
            "estado_aplicacion",
        )
    )


def kpi_reproductivo(ciclo: DataFrame, as_of: str) -> DataFrame:
    """Pregnant cycles, births of the month and success rate in one pass."""
    in_month = F.trunc("fecha_parto_real", "month") == F.trunc(_date(as_of), "month")
    return ciclo.agg(
        F.count_if(F.col("estado_ciclo").isin("Preñez Provisional", "Preñez Confirmada")).alias("vacas_prenadas"),
        F.count_if(F.col("resultado_parto").isin("Exitoso", "Abortado") & in_month).alias("partos_del_mes"),
        percent(F.count_if(F.col("estado_ciclo") == "Parto Exitoso"), F.count("*"), 2).alias("tasa_exito_pct"),
    )


def proximos_eventos(alerta: DataFrame, animal: DataFrame, as_of: str) -> DataFrame:
    """Pending reproductive alerts with the days left, soonest first."""
    return (
        alerta.filter("estado_alerta = 'Pendiente'")
        .join(animal.select("id_animal", "arete"), "id_animal")
        .select(
            "id_alerta",
            "arete",
            "tipo_alerta",
            "fecha_programada",
            "estado_alerta",
            F.datediff("fecha_programada", _date(as_of)).cast("bigint").alias("dias_restantes"),
        )
        .orderBy("fecha_programada", "id_alerta")
    )


def historial_reproductivo(ciclo: DataFrame, animal: DataFrame) -> DataFrame:
    """Cycle phases with ear tag, newest first."""
    return (
        ciclo.join(animal.select("id_animal", "arete"), "id_animal")
        .select(
            "id_ciclo",
            "arete",
            "fecha_inicio",
            "tipo_evento",
            "estado_ciclo",
            "fecha_palpacion1",
            "resultado_palpacion1",
            "fecha_palpacion2",
            "resultado_palpacion2",
            "fecha_parto_real",
            "resultado_parto",
        )
        .orderBy(F.desc("fecha_inicio"), "id_ciclo")
    )
