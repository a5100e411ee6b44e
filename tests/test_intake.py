"""Rules counted by the write that takes rows in."""

from hatospark.model.tables import TABLES
from hatospark.operators.intake import row_rules, take_in

RUN = ("2024-06-30", "2024-06-30 12:00:00")
PEN_MOVE = TABLES["tbl_movimiento_insumo"]


def _take(rows, data, folder):
    df = rows("id_mov_insumo int, tipo_movimiento string, cantidad double, precio_unitario double", data)
    df = df.selectExpr("id_mov_insumo", "tipo_movimiento", *[f"CAST({c} AS DECIMAL(10,2)) AS {c}" for c in df.columns[2:]])
    return take_in(df, PEN_MOVE, *RUN, str(folder))


def test_counts_come_from_the_write(spark, rows, tmp_path):
    data = [(1, "Entrada", 2.0, 3.0), (2, "otra cosa", 0.0, 1.0), (None, None, -1.0, None), (4, "Entrada", None, 5.0)]
    total, broken = _take(rows, data, tmp_path / "a")
    assert total == 4 and broken["regla", "chk_cantidad"] == 2
    assert broken["nulo", "cantidad"] == 1 and broken["nulo", PEN_MOVE.key] == 1
    written = spark.read.parquet(str(tmp_path / "a"))
    assert written.columns == [c.name for c in PEN_MOVE.columns]
    assert sorted(float(r.total) for r in written.collect() if r.total is not None) == [0, 0, 6]
    # The same numbers as a separate read of what was written.
    for rule, sql in row_rules(PEN_MOVE, ["id_mov_insumo", "tipo_movimiento", "cantidad", "precio_unitario"]).items():
        assert written.filter(sql).count() == broken[rule], rule


def test_no_rows(rows, tmp_path):
    total, broken = _take(rows, [], tmp_path / "b")
    assert total == 0 and set(broken.values()) == {0}
