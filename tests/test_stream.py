"""Micro-batches give the same tables as one batch."""

import datetime as dt
from decimal import Decimal

from hatospark.functions.snapshots import read_snapshot, write_snapshot
from hatospark.operators import changes as C
from hatospark.streaming import microbatches as M

SCHEMA = (
    "id_mov_insumo long, id_insumo int, tipo_movimiento string, destino_venta string, cantidad decimal(10,2), "
    "precio_unitario decimal(10,2), proveedor string, cliente string, factura_url string, "
    "fecha_movimiento date, id_usuario int"
)


def _feed(spark, df, folder, files, again=()):
    """A stream of one file per micro-batch, in order of the remainders; some come twice."""
    for n, i in enumerate([*range(files), *again]):
        part = df.filter(f"{df.columns[0]} % {files} = {i}")
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _movements(rows, n):
    kinds = ["Compra", "Venta", "Producción", "Consumo", "Ajuste"]
    data = [
        (i, i % 4, kinds[i % 5], "Venta" if i % 5 == 1 else None, Decimal(i + 1), Decimal(i % 3), None, None, None,
         dt.date(2024, 1, 1), None)
        for i in range(n)
    ]
    insumo = rows("id_insumo int, nombre string, stock_actual decimal(10,2)", [(i, f"n{i}", Decimal(9)) for i in range(5)])
    return rows(SCHEMA, data), insumo


def test_ledger(spark, rows, tmp_path):
    mov, insumo = _movements(rows, 40)
    stream = _feed(spark, mov, f"{tmp_path}/in", 4)
    M.reduce_stream(stream, M.asientos(insumo), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    ledger = spark.read.parquet(f"{tmp_path}/out")
    assert ledger.select("lote").distinct().count() <= 4
    assert sorted(map(str, ledger.drop("lote").collect())) == sorted(map(str, M.asientos(insumo)(mov).collect()))


def test_balances_count_repeated_and_late_movements_once(spark, rows, tmp_path):
    """Batches come out of order and twice, in two runs of the stream; blocks of 16 keys fill up."""
    mov, insumo = _movements(rows, 90)
    folder = f"{tmp_path}/estado"
    M.write_balances(insumo, folder, width=2)
    for again in ((1,), (0, 2)):
        stream = _feed(spark, mov, f"{tmp_path}/in", 3, again)
        M.saldos(stream, folder, insumo, f"{tmp_path}/cp", width=2, bits=4).awaitTermination()
    got = spark.read.parquet(folder)
    want = sorted(C.saldo_insumos(insumo, mov).collect())
    assert sorted(got.select(insumo.columns).collect()) == want
    last = {r.id_insumo: r.lote for r in got.collect()}
    assert last[4] == -1 and all(last[i] >= 0 for i in range(4))  # a supply without movements
    state = spark.read.format("statestore").load(f"{tmp_path}/cp")
    bits = [r.value.groupState for r in state.collect()]
    assert sorted(b.n for b in bits) == [10, 16, 16, 16, 16, 16]
    assert [len(b.bitmap) for b in sorted(bits, key=lambda b: b.n)] == [2, 0, 0, 0, 0, 0]


def test_a_repeated_micro_batch_changes_nothing(spark, rows, tmp_path):
    """The snapshot as a batch that failed half-way left it: one range changed, one not."""
    mov, insumo = _movements(rows, 20)
    folder = f"{tmp_path}/estado"
    want = sorted(C.saldo_insumos(insumo, mov).collect())
    half = C.saldo_insumos(insumo, mov).filter("id_insumo < 2").unionByName(insumo.filter("id_insumo >= 2"))
    write_snapshot(half.selectExpr("*", "if(id_insumo < 2, 0L, -1L) AS lote"), "id_insumo", folder, 2)
    M.saldos(_feed(spark, mov, f"{tmp_path}/in", 1), folder, insumo, f"{tmp_path}/cp", 2).awaitTermination()
    assert sorted(spark.read.parquet(folder).select(insumo.columns).collect()) == want


def test_last_weight_survives_batches_out_of_order(spark, rows, tmp_path):
    animal = rows("id_animal int, peso_actual_kg decimal(7,2)", [(i, Decimal(1)) for i in range(6)])
    pesajes = rows(
        "id_pesaje long, id_animal int, peso_kg decimal(7,2)", [(i, i % 5, Decimal(100 + i)) for i in range(30)]
    )
    folder = f"{tmp_path}/estado"
    write_snapshot(animal, "id_animal", folder, width=2)
    stream = _feed(spark, pesajes, f"{tmp_path}/in", 3, (0, 1))
    M.pesajes(stream, folder, animal, f"{tmp_path}/cp", width=2).awaitTermination()
    got = read_snapshot(spark, folder, animal).collect()
    assert sorted(got) == sorted(C.aplicar_pesajes(animal, pesajes).collect())
    state = spark.read.format("statestore").load(f"{tmp_path}/cp")
    assert state.count() == 5  # one row per animal of the log
