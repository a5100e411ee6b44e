"""Reactions to changed rows.  Each operator takes the current snapshot and a batch
of changes (all new rows, or the old and new state of a table) and returns the
rewritten tables and the rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint
from ..functions.sequence import next_value

AUDIT_FIELDS = (
    "id_alerta",
    "modulo",
    "id_animal",
    "id_origen",
    "tipo",
    "descripcion",
    "prioridad",
    "fecha_programada",
)


# -- animals -------------------------------------------------------------------------


def _retire(animal: DataFrame, events: DataFrame, state: str) -> DataFrame:
    gone = events.select("id_animal").distinct().withColumn("_hit", F.lit(True))
    return (
        animal.join(gone, "id_animal", "left")
        .withColumn("estado_animal", F.when(F.col("_hit"), F.lit(state)).otherwise(F.col("estado_animal")))
        .drop("_hit")
        .select(animal.columns)
    )


def _animal_audit(events: DataFrame, action: str, state: str, reason: str, day: str) -> DataFrame:
    return events.selectExpr(
        "id_animal",
        f"'{action}' AS accion",
        "'Activo' AS estado_anterior",
        f"'{state}' AS estado_nuevo",
        f"{reason} AS motivo",
        f"{day} AS fecha_evento",
    )


def aplicar_mortalidad(animal: DataFrame, muertes: DataFrame) -> dict[str, DataFrame]:
    reason = "'Registro automático por mortalidad'"
    return {
        "tbl_animal": _retire(animal, muertes, "Fallecido"),
        "tbl_animal_auditoria": _animal_audit(muertes, "Muerte", "Fallecido", reason, "fecha_muerte"),
    }


def aplicar_bajas(animal: DataFrame, bajas: DataFrame) -> dict[str, DataFrame]:
    reason = "concat('Baja tipo: ', tipo_baja)"
    return {
        "tbl_animal": _retire(animal, bajas, "Vendido"),
        "tbl_animal_auditoria": _animal_audit(bajas, "Venta", "Vendido", reason, "fecha_baja"),
    }


def latest(batch: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of the last row of each key, with the order it came at."""
    return batch.groupBy(key).agg(
        F.max_by(value, order).alias("_value"), F.max(order).alias("_order")
    )


def apply_latest(snapshot: DataFrame, last: DataFrame, key: str, target: str) -> DataFrame:
    return (
        snapshot.join(last.drop("_order"), key, "left")
        .withColumn(target, F.coalesce("_value", target))
        .select(snapshot.columns)
    )


def aplicar_pesajes(animal: DataFrame, pesajes: DataFrame) -> DataFrame:
    """Current weight = the weight inserted last, whatever its date."""
    return apply_latest(animal, latest(pesajes, "id_animal", "peso_kg", "id_pesaje"), "id_animal", "peso_actual_kg")


def aplicar_movimientos_manga(animal: DataFrame, movimientos: DataFrame) -> DataFrame:
    """Current pen = the destination inserted last."""
    last = latest(movimientos, "id_animal", "id_manga_destino", "id_movimiento")
    return apply_latest(animal, last, "id_animal", "id_manga_actual")


def scd2(history: DataFrame, new: DataFrame, key: str, **kw) -> DataFrame:
    """Append detail rows; a new current row closes the open row of its animal.

    A current row of the batch is closed by the next current one of the batch,
    and the open rows of the snapshot by the first.
    """
    current = F.when(F.col("es_vigente"), F.col("fecha_inicio"))
    closed = F.col("es_vigente") & F.col("_closes").isNotNull()
    columns = history.columns

    def close(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                "fecha_fin": F.when(closed, F.col("_closes")).otherwise(F.col("fecha_fin")),
                "es_vigente": F.col("es_vigente") & ~closed,
            }
        ).select(columns)

    first = new.filter("es_vigente").groupBy("id_animal").agg(F.min_by("fecha_inicio", key).alias("_closes"))
    added = next_value(new, ["id_animal"], key, current, "_closes", **kw)
    return close(history.join(first, "id_animal", "left")).unionByName(close(added))


# -- supplies --------------------------------------------------------------------------


def signed_totals(movimientos: DataFrame) -> DataFrame:
    """Net quantity per supply; adjustments do not count."""
    sign = (
        "CASE WHEN tipo_movimiento IN ('Compra', 'Producción') THEN cantidad "
        "WHEN tipo_movimiento IN ('Venta', 'Consumo') THEN -cantidad END"
    )
    return movimientos.groupBy("id_insumo").agg(F.sum(F.expr(sign)).alias("_delta"))


#: Reason of a refused change of a stored amount.
OUT_OF_RANGE = "importe fuera de rango"


def _new_stock(insumo: DataFrame, totals: DataFrame) -> DataFrame:
    """``_nuevo`` is NULL where the balance does not fit its column."""
    stock = F.col("stock_actual") + F.coalesce(F.col("_delta"), F.lit(0))
    return insumo.join(totals, "id_insumo", "left").withColumn("_nuevo", stock.try_cast("decimal(10,2)"))


def apply_totals(insumo: DataFrame, totals: DataFrame) -> DataFrame:
    """Supplies with their new balance; one that would leave its range keeps the old one."""
    return (
        _new_stock(insumo, totals)
        .withColumn("stock_actual", F.coalesce("_nuevo", F.col("stock_actual").cast("decimal(10,2)")))
        .select(insumo.columns)
    )


def saldo_insumos(insumo: DataFrame, movimientos: DataFrame) -> DataFrame:
    return apply_totals(insumo, signed_totals(movimientos))


def saldos_rechazados(insumo: DataFrame, movimientos: DataFrame) -> DataFrame:
    """The supplies whose movements of the batch are refused, with the reason."""
    refused = _new_stock(insumo, signed_totals(movimientos)).filter(
        "_nuevo IS NULL AND _delta IS NOT NULL AND stock_actual IS NOT NULL"
    )
    return refused.select("id_insumo", F.lit(OUT_OF_RANGE).alias("motivo"))


def asientos_rechazados(movimientos: DataFrame) -> DataFrame:
    """Priced purchases and sales whose amount does not fit the ledger, with the reason."""
    posted = (
        "precio_unitario > 0 AND (tipo_movimiento = 'Compra' OR "
        "tipo_movimiento = 'Venta' AND destino_venta = 'Venta')"
    )
    refused = movimientos.filter(posted).filter(f"{_AMOUNT} IS NULL AND cantidad IS NOT NULL")
    return refused.select("id_mov_insumo", F.lit(OUT_OF_RANGE).alias("motivo"))


_AMOUNT = "try_cast(cantidad * precio_unitario AS DECIMAL(12,2))"


def _ledger(rows: DataFrame, insumo: DataFrame, kind: str, verb: str, text: str) -> DataFrame:
    names = insumo.select("id_insumo", F.col("nombre").alias("_nombre"))
    fits = rows.filter(f"{_AMOUNT} IS NOT NULL OR cantidad IS NULL")
    return fits.join(names, "id_insumo", "left").selectExpr(
        f"'{kind}' AS categoria",
        "fecha_movimiento AS fecha_transaccion",
        f"concat('{verb}: ', coalesce(_nombre, 'Insumo Desconocido')) AS concepto",
        f"{text} AS descripcion",
        f"{_AMOUNT} AS monto",
        "'ejecutado' AS estado",
        f"'{verb} Insumo' AS tipo_origen",
        "id_mov_insumo",
        "id_usuario",
    )


def contabilizar_compras(movimientos: DataFrame, insumo: DataFrame) -> DataFrame:
    """Priced purchases as expense entries."""
    text = (
        "concat('Proveedor: ', coalesce(proveedor, 'N/A'), ' | Cant: ', CAST(cantidad AS STRING), "
        "' | Factura: ', coalesce(factura_url, 'S/F'))"
    )
    bought = movimientos.filter("tipo_movimiento = 'Compra' AND precio_unitario > 0")
    return _ledger(bought, insumo, "gasto", "Compra", text)


def contabilizar_ventas(movimientos: DataFrame, insumo: DataFrame) -> DataFrame:
    """Priced sales to third parties as income entries."""
    text = "concat('Cliente: ', coalesce(cliente, 'N/A'), ' | Cant: ', CAST(cantidad AS STRING))"
    sold = movimientos.filter(
        "tipo_movimiento = 'Venta' AND precio_unitario > 0 AND destino_venta = 'Venta'"
    )
    return _ledger(sold, insumo, "ingreso", "Venta", text)


def registrar_movimientos(insumo: DataFrame, movimientos: DataFrame) -> dict[str, DataFrame]:
    """All that a batch of stock movements changes, from one read of the batch."""
    batch = checkpoint(movimientos)
    reasons = asientos_rechazados(batch).select(
        F.lit("asiento").alias("destino"), F.col("id_mov_insumo").alias("id"), "motivo"
    )
    return {
        "tbl_insumo": saldo_insumos(insumo, batch),
        "tbl_transaccion_financiera": contabilizar_compras(batch, insumo).unionByName(
            contabilizar_ventas(batch, insumo)
        ),
        "rechazadas": reasons.union(
            saldos_rechazados(insumo, batch).select(F.lit("saldo"), "id_insumo", "motivo")
        ),
    }


# -- alerts ----------------------------------------------------------------------------


def _alert_audit(alerts: DataFrame, before, after, action, user: str, run_ts: str) -> DataFrame:
    return alerts.select(
        *AUDIT_FIELDS,
        before.alias("estado_anterior"),
        after.alias("estado_nuevo"),
        action.alias("accion_auditoria"),
        F.lit(run_ts).cast("timestamp").alias("fecha_auditoria"),
        F.lit(user).alias("usuario_auditor"),
    )


def auditar_alertas_alta(nuevas: DataFrame, user: str, run_ts: str) -> DataFrame:
    return _alert_audit(nuevas, F.lit("N/A"), F.col("estado"), F.lit("Creada"), user, run_ts)


def state_action(state: Column) -> Column:
    return F.when(state.isin("Atendida", "Cancelada"), state).otherwise("Modificada")


def auditar_alertas_cambio(antes: DataFrame, despues: DataFrame, user: str, run_ts: str) -> DataFrame:
    """One audit row per alert whose state differs between the snapshots."""
    old = antes.select("id_alerta", F.col("estado").alias("_antes"))
    changed = despues.join(old, "id_alerta").filter("_antes <> estado")
    return _alert_audit(changed, F.col("_antes"), F.col("estado"), state_action(F.col("estado")), user, run_ts)


def auditar_alertas_baja(
    antes: DataFrame, despues: DataFrame, auditoria: DataFrame, user: str, run_ts: str
) -> DataFrame:
    """The audit log after deletes: a row per deleted alert, and no row names one."""
    deleted = antes.join(despues.select("id_alerta"), "id_alerta", "left_anti")
    added = _alert_audit(
        deleted.withColumn("id_alerta", F.lit(None).cast("bigint")),
        F.col("estado"),
        F.lit(None).cast("string"),
        F.lit("Eliminada"),
        user,
        run_ts,
    )
    kept = (
        auditoria.join(
            deleted.select("id_alerta", F.lit(True).alias("_hit")), "id_alerta", "left"
        )
        .withColumn("id_alerta", F.when(F.col("_hit").isNull(), F.col("id_alerta")))
        .select(auditoria.columns)
    )
    return kept.unionByName(added, allowMissingColumns=True)


def cerrar_alertas_sanidad(
    antes: DataFrame,
    despues: DataFrame,
    tratados: DataFrame,
    alertas: DataFrame,
    user: str,
    run_ts: str,
) -> dict[str, DataFrame]:
    """Attend the pending health alerts of the animals and dates of doses just applied."""
    old = antes.select("id_programacion", F.col("estado").alias("_antes"))
    doses = (
        despues.filter("estado = 'Aplicado'")
        .join(old, "id_programacion")
        .filter("_antes <> 'Aplicado'")
        .select("id_registro_san", F.col("fecha_programada").cast("date").alias("_dia"))
        .distinct()
    )
    closed = (
        tratados.select("id_registro_san", "id_animal")
        .join(doses, "id_registro_san")
        .select("id_animal", "_dia")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    day = F.col("fecha_programada").cast("date")
    joined = alertas.withColumn("_dia", day).join(closed, ["id_animal", "_dia"], "left")
    hit = F.col("_hit") & (F.col("modulo") == "Sanidad") & (F.col("estado") == "Pendiente")
    attended = joined.filter(hit)
    return {
        "tbl_alerta": joined.withColumns(
            {
                "estado": F.when(hit, F.lit("Atendida")).otherwise(F.col("estado")),
                "fecha_atendida": F.when(hit, F.lit(run_ts).cast("timestamp_ntz")).otherwise(
                    F.col("fecha_atendida")
                ),
            }
        ).select(alertas.columns),
        "tbl_auditoria_alerta": _alert_audit(
            attended, F.col("estado"), F.lit("Atendida"), F.lit("Atendida"), user, run_ts
        ),
    }


# -- reproductive cycles -----------------------------------------------------------------

PREGNANT = ("Preñez Provisional", "Preñez Confirmada")
EMPTY = ("Vacía", "Parto Exitoso", "Abortado")


def cow_state(state: Column) -> Column:
    """The reproductive state a cow takes when her cycle enters ``state``."""
    return F.when(state.isin(*PREGNANT), F.lit("Preñada")).when(state.isin(*EMPTY), F.lit("Vacía"))


def completed_alert(old: Column, new: Column) -> Column:
    """The kind of pending alert that a change of phase completes."""
    return (
        F.when((old == "Pendiente Palpación 1") & new.isin("Preñez Provisional", "Vacía"), F.lit("Palpación 1"))
        .when((old == "Preñez Provisional") & new.isin("Preñez Confirmada", "Vacía"), F.lit("Palpación 2"))
        .when((old == "Preñez Confirmada") & new.isin("Parto Exitoso", "Abortado"), F.lit("Parto Estimado"))
    )


def set_cow_state(vaca: DataFrame, states: DataFrame) -> DataFrame:
    """Write ``_vaca`` (one row per animal) into the current detail rows."""
    hit = F.col("es_vigente") & F.col("_vaca").isNotNull()
    return (
        vaca.join(states, "id_animal", "left")
        .withColumn(
            "estado_reproductivo",
            F.when(hit, F.col("_vaca")).otherwise(F.col("estado_reproductivo")),
        )
        .select(vaca.columns)
    )


def sincronizar_ciclos(
    antes: DataFrame, despues: DataFrame, vaca: DataFrame, alertas: DataFrame
) -> dict[str, DataFrame]:
    """Cow state and completed alerts after cycles changed phase.

    Where several cycles of a cow changed at once, the highest of those that set a state decides.
    """
    old = antes.select("id_ciclo", F.col("estado_ciclo").alias("_antes"))
    changed = (
        despues.select("id_ciclo", "id_animal", "estado_ciclo")
        .join(old, "id_ciclo")
        .filter("_antes <> estado_ciclo")
    )
    # Phases that set no state do not hide the state another cycle set.
    states = (
        changed.select("id_animal", "id_ciclo", cow_state(F.col("estado_ciclo")).alias("_vaca"))
        .filter("_vaca IS NOT NULL")
        .groupBy("id_animal")
        .agg(F.max_by("_vaca", "id_ciclo").alias("_vaca"))
    )
    done = changed.select(
        "id_ciclo", completed_alert(F.col("_antes"), F.col("estado_ciclo")).alias("_tipo")
    ).filter("_tipo IS NOT NULL")
    hit = (F.col("tipo_alerta") == F.col("_tipo")) & (F.col("estado_alerta") == "Pendiente")
    return {
        "tbl_vaca_detalle": set_cow_state(vaca, states),
        "tbl_alerta_reproductiva": alertas.join(done, "id_ciclo", "left")
        .withColumn("estado_alerta", F.when(hit, F.lit("Completada")).otherwise(F.col("estado_alerta")))
        .select(alertas.columns),
    }


def revertir_ciclos_borrados(antes: DataFrame, despues: DataFrame, vaca: DataFrame) -> DataFrame:
    """Cows of deleted cycles go back to empty."""
    gone = antes.join(despues.select("id_ciclo"), "id_ciclo", "left_anti")
    return set_cow_state(vaca, gone.select("id_animal").distinct().withColumn("_vaca", F.lit("Vacía")))
