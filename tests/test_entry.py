"""The driver contract, and registered queries against their oracle SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from hatospark.model.tables import TABLES, foreign_keys
from hatospark.sources.derived import BASE, DERIVED
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "animal_completo",
    "inventario_mangas",
    "expediente_sanitario",
    "kpi_reproductivo",
    "scd2_toro",
    "saldo_insumos",
    "auditar_alertas_baja",
    "cerrar_alertas_sanidad__tbl_alerta",
    "resolver_causas__resueltas",
    "sanidad_individual__tbl_alerta",
    "liquidar_leche__tbl_transaccion_leche",
    "editar_palpacion1__tbl_alerta_reproductiva",
    "fk_huerfanos",
    "claves_duplicadas",
    "borrado_en_cascada__tbl_ternero_detalle",
]


def test_model_is_complete():
    assert len(TABLES) == 37 and set(DERIVED) == set(TABLES)
    assert len(foreign_keys()) == 60
    assert sum(not c.update_cascades for _, c in foreign_keys()) == 7


def test_entry_has_rows_and_every_oracle_has_a_query(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{SF}/{b}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())
