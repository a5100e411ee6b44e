"""Golden cases of the change operators."""

import datetime as dt
from decimal import Decimal

from hatospark.operators import changes as C

D = dt.date


def test_last_inserted_weight_wins_over_a_later_date(rows):
    animal = rows("id_animal int, peso_actual_kg decimal(7,2)", [(1, Decimal(5)), (2, Decimal(6))])
    pesajes = rows(
        "id_pesaje long, id_animal int, fecha_pesaje date, peso_kg decimal(7,2)",
        [(1, 1, D(2024, 5, 1), Decimal(100)), (2, 1, D(2024, 1, 1), Decimal(90))],
    )
    got = {r.id_animal: r.peso_actual_kg for r in C.aplicar_pesajes(animal, pesajes).collect()}
    assert got == {1: Decimal(90), 2: Decimal(6)}


def test_scd2_three_rows_in_a_batch_and_a_row_that_is_not_current(rows):
    schema = "id_vaca_detalle long, id_animal int, fecha_inicio date, fecha_fin date, es_vigente boolean"
    history = rows(schema, [(1, 1, D(2020, 1, 1), None, True), (2, 1, D(2019, 1, 1), D(2020, 1, 1), False),
                            (3, 2, D(2020, 1, 1), None, True)])
    new = rows(schema, [(10, 1, D(2021, 1, 1), None, True), (11, 1, D(2022, 1, 1), None, False),
                        (19, 1, D(2023, 1, 1), None, True), (33, 2, D(2023, 6, 1), None, False)])
    got = {r.id_vaca_detalle: (r.fecha_fin, r.es_vigente) for r in
           C.scd2(history, new, "id_vaca_detalle", bits=2).collect()}
    assert got == {
        1: (D(2021, 1, 1), False), 2: (D(2020, 1, 1), False), 3: (None, True),
        10: (D(2023, 1, 1), False), 11: (None, False), 19: (None, True), 33: (None, False),
    }


def test_adjustments_leave_the_stock_alone_and_it_may_go_negative(rows):
    insumo = rows("id_insumo int, stock_actual decimal(10,2)", [(1, Decimal(1)), (2, Decimal(3))])
    mov = rows(
        "id_insumo int, tipo_movimiento string, cantidad decimal(10,2)",
        [(1, "Venta", Decimal(5)), (1, "Producción", Decimal(2)), (2, "Ajuste", Decimal(9))],
    )
    got = {r.id_insumo: r.stock_actual for r in C.saldo_insumos(insumo, mov).collect()}
    assert got == {1: Decimal(-2), 2: Decimal(3)}


MOV = (
    "id_mov_insumo long, id_insumo int, tipo_movimiento string, destino_venta string, cantidad decimal(10,2), "
    "precio_unitario decimal(10,2), proveedor string, cliente string, factura_url string, "
    "fecha_movimiento date, id_usuario int"
)


def _mov(i, kind, dest, price, **kw):
    return (i, 1, kind, dest, Decimal("2.50"), price, kw.get("proveedor"), kw.get("cliente"), None, D(2024, 1, 1), 3)


def test_ledger_skips_unpriced_movements_and_own_use(rows):
    insumo = rows("id_insumo int, nombre string", [(1, "Sal")])
    mov = rows(MOV, [
        _mov(1, "Compra", None, Decimal("3.00"), proveedor="P"), _mov(2, "Compra", None, None),
        _mov(3, "Compra", None, Decimal("0.00")), _mov(4, "Venta", "Venta", Decimal("4.10"), cliente="C"),
        _mov(5, "Venta", "Consumo Animal", Decimal("4.00")), _mov(6, "Venta", None, Decimal("4.00")),
    ])
    [buy] = C.contabilizar_compras(mov, insumo).collect()
    assert (buy.concepto, buy.descripcion, buy.monto, buy.categoria) == (
        "Compra: Sal", "Proveedor: P | Cant: 2.50 | Factura: S/F", Decimal("7.50"), "gasto")
    [sale] = C.contabilizar_ventas(mov, insumo).collect()
    assert (sale.id_mov_insumo, sale.descripcion, sale.monto) == (4, "Cliente: C | Cant: 2.50", Decimal("10.25"))


ALERT = (
    "id_alerta long, modulo string, id_animal int, id_origen long, tipo string, descripcion string, "
    "prioridad string, fecha_programada date, estado string, fecha_atendida timestamp_ntz"
)


def _alert(i, animal, day, state, module="Sanidad"):
    return (i, module, animal, None, "t", None, "Normal", day, state, None)


def test_deleted_alerts_are_logged_and_no_log_row_names_them(rows):
    before = rows(ALERT, [_alert(1, 1, D(2024, 1, 1), "Pendiente"), _alert(2, 1, D(2024, 1, 1), "Atendida")])
    after = before.filter("id_alerta = 2")
    log = C.auditar_alertas_alta(before, "u", "2024-01-01 00:00:00")
    got = C.auditar_alertas_baja(before, after, log, "u", "2024-01-02 00:00:00").collect()
    assert sorted(((r.id_alerta, r.accion_auditoria, r.estado_nuevo) for r in got), key=str) == sorted(
        [(None, "Creada", "Pendiente"), (2, "Creada", "Atendida"), (None, "Eliminada", None)], key=str)


def test_applied_dose_closes_the_alert_of_another_event_on_the_same_day(rows):
    schema = "id_programacion long, id_registro_san long, fecha_programada timestamp_ntz, estado string"
    noon = dt.datetime(2024, 5, 1, 12)
    before = rows(schema, [(1, 7, noon, "Pendiente"), (2, 8, noon, "Aplicado")])
    after = rows(schema, [(1, 7, noon, "Aplicado"), (2, 8, noon, "Aplicado")])
    treated = rows("id_registro_san long, id_animal int", [(7, 1), (8, 2)])
    alerts = rows(ALERT, [
        _alert(1, 1, D(2024, 5, 1), "Pendiente"), _alert(2, 1, D(2024, 5, 1), "Pendiente", "General"),
        _alert(3, 1, D(2024, 5, 2), "Pendiente"), _alert(4, 2, D(2024, 5, 1), "Pendiente"),
        _alert(5, 1, D(2024, 5, 1), "Cancelada"),
    ])
    got = C.cerrar_alertas_sanidad(before, after, treated, alerts, "u", "2024-05-01 15:00:00")
    assert {r.id_alerta for r in got["tbl_alerta"].filter("estado = 'Atendida'").collect()} == {1}
    assert [r.id_alerta for r in got["tbl_auditoria_alerta"].collect()] == [1]
    assert got["tbl_alerta"].count() == 5


def test_a_balance_out_of_range_refuses_its_own_supply_only(rows):
    insumo = rows("id_insumo int, stock_actual decimal(10,2)", [(1, Decimal(1)), (2, Decimal(3)), (3, None)])
    mov = rows(
        "id_insumo int, tipo_movimiento string, cantidad decimal(18,2)",
        [(1, "Compra", Decimal(99_999_999)), (1, "Compra", Decimal(5)), (2, "Compra", Decimal(4)), (3, "Compra", Decimal(1))],
    )
    got = {r.id_insumo: r.stock_actual for r in C.saldo_insumos(insumo, mov).collect()}
    assert got == {1: Decimal(1), 2: Decimal(7), 3: None}
    assert [tuple(r) for r in C.saldos_rechazados(insumo, mov).collect()] == [(1, C.OUT_OF_RANGE)]


def test_an_amount_out_of_range_refuses_its_own_entry_only(rows):
    insumo = rows("id_insumo int, nombre string, stock_actual decimal(10,2)", [(1, "Sal", Decimal(0))])
    mov = rows(
        "id_mov_insumo long, id_insumo int, tipo_movimiento string, destino_venta string, cantidad decimal(18,2), "
        "precio_unitario decimal(10,2), fecha_movimiento date, proveedor string, cliente string, "
        "factura_url string, id_usuario int",
        [
            (1, 1, "Compra", None, Decimal(10**9), Decimal(100), D(2024, 1, 1), "P", None, None, 1),
            (2, 1, "Compra", None, Decimal(2), Decimal(3), D(2024, 1, 1), "P", None, "f.pdf", 1),
            (3, 1, "Venta", "Venta", Decimal(10**9), Decimal(100), D(2024, 1, 1), None, "C", None, 1),
            (4, 1, "Venta", "Venta", Decimal(1), Decimal(3), D(2024, 1, 1), None, "C", None, 1),
            (5, 1, "Venta", "Consumo Animal", Decimal(10**9), Decimal(100), D(2024, 1, 1), None, "C", None, 1),
        ],
    )
    out = C.registrar_movimientos(insumo, mov)
    posted = {r.id_mov_insumo: (r.monto, r.descripcion) for r in out["tbl_transaccion_financiera"].collect()}
    assert posted == {
        2: (Decimal(6), "Proveedor: P | Cant: 2.00 | Factura: f.pdf"),
        4: (Decimal(3), "Cliente: C | Cant: 1.00"),
    }
    refused = {(r.destino, r.id) for r in out["rechazadas"].collect()}
    assert refused == {("asiento", 1), ("asiento", 3), ("saldo", 1)}
    assert out["tbl_insumo"].first().stock_actual == 0


def test_a_phase_without_a_cow_state_does_not_hide_another_cycle(rows):
    before = rows("id_ciclo long, estado_ciclo string", [(1, "Pendiente Palpación 1"), (2, "Vacía")])
    after = rows(
        "id_ciclo long, id_animal int, estado_ciclo string",
        [(1, 7, "Preñez Provisional"), (2, 7, "Pendiente Palpación 1")],
    )
    cow = rows("id_animal int, estado_reproductivo string, es_vigente boolean", [(7, "Vacía", True)])
    alerts = rows("id_ciclo long, tipo_alerta string, estado_alerta string")
    out = C.sincronizar_ciclos(before, after, cow, alerts)["tbl_vaca_detalle"].first()
    assert out.estado_reproductivo == "Preñada"


def test_health_alerts_close_for_their_module_animal_and_day(rows):
    before = rows("id_programacion long, estado string", [(1, "Pendiente"), (2, "Aplicado")])
    after = rows(
        "id_programacion long, id_registro_san long, fecha_programada date, estado string",
        [(1, 10, D(2024, 1, 1), "Aplicado"), (2, 10, D(2024, 1, 2), "Aplicado")],
    )
    treated = rows("id_registro_san long, id_animal int", [(10, 1), (10, 2)])
    fields = "id_alerta long, modulo string, id_animal int, id_origen long, tipo string, descripcion string, prioridad string, fecha_programada date, estado string, fecha_atendida timestamp_ntz"
    alerts = [
        (1, "Sanidad", 1, None, "x", None, "Normal", D(2024, 1, 1), "Pendiente", None),
        (2, "General", 2, None, "x", None, "Normal", D(2024, 1, 1), "Pendiente", None),
        (3, "Sanidad", 2, None, "x", None, "Normal", D(2024, 1, 2), "Pendiente", None),
        (4, "Sanidad", 2, None, "x", None, "Normal", D(2024, 1, 1), "Cancelada", None),
        (5, "Sanidad", 2, None, "x", None, "Normal", D(2024, 1, 1), "Pendiente", None),
    ]
    out = C.cerrar_alertas_sanidad(before, after, treated, rows(fields, alerts), "u", "2024-02-01 00:00:00")
    closed = {r.id_alerta for r in out["tbl_alerta"].collect() if r.estado == "Atendida"}
    assert closed == {1, 5} == {r.id_alerta for r in out["tbl_auditoria_alerta"].collect()}
