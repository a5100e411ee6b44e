"""Reports kept current from batches: signed deltas of groups.

A report's groups are kept as sums over signed rows: a new row counts once, a row that is gone (or the former
state of a changed one) counts minus once.  After a batch, the groups are the old groups plus those of the
batch's signed rows; neither reads the tables again.  Each group keeps the number of its rows, so a
group that lost its last row goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import reports as R

SIGN, ROWS = "signo", "filas"


def signed(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The rows that a batch brings (+1) and those that it replaces or deletes (-1)."""
    plus = new.withColumn(SIGN, F.lit(1))
    return plus if old is None else plus.unionByName(old.withColumn(SIGN, F.lit(-1)))


def _grouped(rows: DataFrame, keys: list[Column], sums: dict[str, Column]) -> DataFrame:
    totals = [F.sum(value * F.col(SIGN)).alias(name) for name, value in sums.items()]
    # A delta of no rows can still change a sum.
    return rows.groupBy(*keys).agg(*totals, F.sum(SIGN).cast("bigint").alias(ROWS))


def merged(groups: DataFrame, delta: DataFrame) -> DataFrame:
    """The groups after a batch: ``groups`` and ``delta`` have the same columns, one row per group."""
    keys = [f.name for f in groups.schema.fields if f.name not in _SUMS]
    both = groups.unionByName(delta)
    sums = [F.sum(c).cast(groups.schema[c].dataType).alias(c) for c in groups.columns if c not in keys]
    return both.groupBy(*keys).agg(*sums).filter(f"{ROWS} <> 0").select(groups.columns)


#: Columns of groups that add up.
_SUMS = {ROWS, "ingresos", "gastos"}


# -- heads per pen ---------------------------------------------------------------------


def cabezas(animals: DataFrame) -> DataFrame:
    """Living heads per pen, from signed animals."""
    alive = animals.filter(~F.col("estado_animal").isin("Fallecido", "Vendido"))
    return _grouped(alive.filter("id_manga_actual IS NOT NULL"), [F.col("id_manga_actual").alias("id_manga")], {})


def inventario_de(groups: DataFrame, manga: DataFrame) -> DataFrame:
    """The pen inventory from its groups."""
    heads = groups.select("id_manga", F.col(ROWS).alias("cabezas"))
    return R.inventario(manga, heads)


# -- ledger ------------------------------------------------------------------------------


def importes(transactions: DataFrame) -> DataFrame:
    """Income and expense per month, from signed transactions."""

    def amount(kind):
        value = F.when(F.col("categoria") == kind, F.col("monto"))
        return F.coalesce(value, F.lit(0)).cast("decimal(36,2)")

    keys = [F.year("fecha_transaccion").cast("bigint").alias("anio"), F.month("fecha_transaccion").cast("bigint").alias("mes")]
    groups = _grouped(transactions, keys, {"ingresos": amount("ingreso"), "gastos": amount("gasto")})
    return groups.withColumns({c: F.col(c).cast("decimal(38,2)") for c in ("ingresos", "gastos")})


def resumen_de(groups: DataFrame) -> DataFrame:
    """The monthly summary from its groups."""
    return groups.select(
        "anio", "mes", F.col("ingresos").alias("total_ingresos"), F.col("gastos").alias("total_gastos"),
        (F.col("ingresos") - F.col("gastos")).cast("decimal(38,2)").alias("balance"),
    ).orderBy(F.desc("anio"), F.desc("mes"))


# -- cycles ------------------------------------------------------------------------------


def fases(cycles: DataFrame) -> DataFrame:
    """Cycles per state, birth result and month of birth, from signed cycles."""
    month = F.trunc("fecha_parto_real", "month").alias("mes_parto")
    return _grouped(cycles, [F.col("estado_ciclo"), F.col("resultado_parto"), month], {})


def kpi_de(groups: DataFrame, as_of: str) -> DataFrame:
    """The reproductive indicators from their groups."""

    def count(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(ROWS))), F.lit(0)).cast("bigint")

    in_month = F.col("mes_parto") == F.trunc(F.lit(as_of).cast("date"), "month")
    return groups.agg(
        count(F.col("estado_ciclo").isin("Preñez Provisional", "Preñez Confirmada")).alias("vacas_prenadas"),
        count(F.col("resultado_parto").isin("Exitoso", "Abortado") & in_month).alias("partos_del_mes"),
        R.percent(count(F.col("estado_ciclo") == "Parto Exitoso"), count(F.lit(True)), 2).alias("tasa_exito_pct"),
    )


# -- supplies ------------------------------------------------------------------------------


def stock_bajo_tras(old: DataFrame, changed: DataFrame) -> DataFrame:
    """Low stock after a batch: the old report without the supplies that changed, and these judged anew."""
    kept = old.join(changed.select("id_insumo"), "id_insumo", "left_anti")
    return kept.unionByName(R.stock_bajo(changed)).orderBy("diferencia", "id_insumo")
