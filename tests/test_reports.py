"""Golden cases of the read queries."""

import datetime as dt
from decimal import Decimal

from hatospark.operators import reports as R

D = dt.date


def _catalogues(rows):
    raza = rows("id_raza int, nombre_raza string, proposito string", [(1, "Brahman", "Carne")])
    manga = rows("id_manga int, numero_manga int, nombre string", [(1, 101, "Norte")])
    procedencia = rows("id_procedencia int, nombre string", [(1, "Nacido")])
    return raza, manga, procedencia


ANIMAL = (
    "id_animal int, arete string, trazabilidad string, tipo_animal string, sexo string, id_raza int, "
    "id_manga_actual int, id_procedencia int, fecha_nacimiento date, peso_actual_kg decimal(7,2), "
    "estado_animal string"
)


def test_animal_completo_counts_full_months_and_keeps_double_current_rows(rows):
    animal = rows(
        ANIMAL,
        [
            (1, "A1", "000001", "Vaca", "F", 1, 1, None, D(2024, 1, 31), Decimal("1.00"), "Activo"),
            (2, "A2", "000002", "Toro", "M", 1, None, 1, D(2023, 2, 28), None, "Activo"),
        ],
    )
    vaca = rows(
        "id_vaca_detalle long, id_animal int, estado_ordeno string, estado_reproductivo string, es_vigente boolean",
        [(1, 1, "Activo", "Vacía", True), (2, 1, "Inactivo", "Seca", True), (3, 1, "Activo", "Parida", False)],
    )
    toro = rows(
        "id_toro_detalle long, id_animal int, tipo_uso string, activo_reproduccion boolean, "
        "libido_evaluacion string, es_vigente boolean"
    )
    ternero = rows(
        "id_ternero_detalle long, id_animal int, estado_lactancia string, peso_nacimiento_kg decimal(6,2), "
        "peso_destete_kg decimal(6,2), es_vigente boolean"
    )
    got = R.animal_completo(animal, *_catalogues(rows), vaca, toro, ternero, "2024-02-29").collect()
    assert len(got) == 3
    assert {r.edad_meses for r in got if r.id_animal == 1} == {0}
    assert {r.estado_ordeno for r in got if r.id_animal == 1} == {"Activo", "Inactivo"}
    [bull] = [r for r in got if r.id_animal == 2]
    assert (bull.edad_meses, bull.manga_actual, bull.procedencia, bull.tipo_uso) == (12, None, "Nacido", None)


def test_inventario_mangas_empty_pen_zero_capacity_and_inactive(rows):
    manga = rows(
        "id_manga int, numero_manga int, nombre string, funcion string, capacidad_max int",
        [(1, 1, "a", "Cría", 3), (2, 2, "b", "Cría", 0), (3, 3, "c", "Cría", 10)],
    )
    animal = rows(
        "id_animal int, id_manga_actual int, estado_animal string",
        [(1, 1, "Activo"), (2, 1, "Inactivo"), (3, 1, "Vendido"), (4, 2, "Activo"), (5, None, "Activo")],
    )
    got = {r.id_manga: (r.cantidad_actual, r.pct_ocupacion) for r in R.inventario_mangas(manga, animal).collect()}
    assert got == {1: (2, 66.7), 2: (1, None), 3: (0, 0.0)}


def test_produccion_reciente_includes_day_thirty_and_the_future(rows):
    raza, manga, _ = _catalogues(rows)
    animal = rows("id_animal int, arete string, id_raza int, id_manga_actual int", [(1, "A", 1, None)])
    days = [D(2024, 1, 1), D(2024, 1, 2), D(2024, 2, 1)]
    leche = rows(
        "id_animal int, fecha_ordeno date, litros_manana decimal(6,2), litros_tarde decimal(6,2), "
        "total_litros decimal(6,2)",
        [(1, d, Decimal(1), Decimal(1), Decimal(2)) for d in days],
    )
    got = R.produccion_reciente(leche, animal, raza, manga, "2024-02-01").collect()
    assert [r.fecha_ordeno for r in got] == [D(2024, 2, 1), D(2024, 1, 2)]


def test_alertas_pendientes_order(rows):
    alerta = rows(
        "id_alerta long, modulo string, tipo string, descripcion string, prioridad string, fecha_programada date, "
        "enviar_correo boolean, correo_enviado boolean, notificacion_vista boolean, estado string, "
        "id_animal int, id_usuario_atiende int",
        [
            (i, "General", "t", None, p, d, False, False, False, s, None, None)
            for i, p, d, s in [
                (1, "Baja", D(2024, 1, 1), "Pendiente"),
                (2, "Urgente", D(2024, 1, 9), "Pendiente"),
                (3, "Urgente", D(2024, 1, 2), "Pendiente"),
                (4, "Rara", D(2024, 1, 3), "Pendiente"),
                (5, "Normal", D(2024, 1, 1), "Pendiente"),
                (6, "Urgente", D(2024, 1, 1), "Atendida"),
            ]
        ],
    )
    animal = rows("id_animal int, arete string, tipo_animal string, estado_animal string")
    usuario = rows("id_usuario int, nombre_completo string")
    got = R.alertas_pendientes(alerta, animal, usuario).collect()
    assert [r.id_alerta for r in got] == [4, 3, 2, 5, 1]


def test_kpi_over_no_cycles(rows):
    ciclo = rows("estado_ciclo string, resultado_parto string, fecha_parto_real date")
    [r] = R.kpi_reproductivo(ciclo, "2024-01-01").collect()
    assert tuple(r) == (0, 0, None)


def test_expediente_two_doses_make_two_rows_and_missing_dose_is_null(rows):
    tratado = rows("id_registro_san long, id_animal int, estado_aplicacion string", [(1, 1, "Aplicado"), (2, 1, "Aplicado")])
    registro = rows(
        "id_registro_san long, fecha_aplicacion date, categoria string, dosis_valor decimal(8,2), "
        "dosis_unidad string, id_producto int, id_causa int, id_veterinario int",
        [
            (1, D(2024, 1, 1), "Tratamiento", Decimal("5.00"), "ml", 1, 1, None),
            (2, D(2024, 1, 2), "Vacunación", None, "ml", None, None, None),
        ],
    )
    prog = rows(
        "id_programacion long, id_registro_san long, fecha_programada date, estado string",
        [(1, 1, D(2024, 2, 1), "Pendiente"), (2, 1, D(2024, 3, 1), "Pendiente"), (3, 2, D(2024, 2, 1), "Aplicado")],
    )
    got = R.expediente_sanitario(
        tratado,
        registro,
        rows("id_animal int, arete string", [(1, "A")]),
        rows("id_producto int, nombre string", [(1, "Suero")]),
        rows("id_causa int, causa_principal string, detalle_causa string", [(1, "Otros", None)]),
        rows("id_colaborador int, nombre string"),
        prog,
    ).collect()
    shown = sorted(
        (r.id_registro_san, r.detalle_tratamiento, r.dosis_aplicada, r.proxima_dosis_revision) for r in got
    )
    assert shown == [
        (1, "Otros — Suero", "5.00 ml", D(2024, 2, 1)),
        (1, "Otros — Suero", "5.00 ml", D(2024, 3, 1)),
        (2, "Sin diagnóstico — Sin producto", None, None),
    ]


def test_ties_are_sorted_by_the_key(rows):
    day = D(2024, 1, 1)
    ids = [5, 3, 9, 1, 7]
    animal = rows("id_animal int, arete string, tipo_animal string, estado_animal string, id_raza int, id_manga_actual int",
                  [(1, "a", "Vaca", "Activo", 1, 1)])
    raza = rows("id_raza int, nombre_raza string", [(1, "r")])
    user = rows("id_usuario int, nombre_completo string", [(1, "u")])
    cause = rows("id_causa int, causa_principal string, detalle_causa string", [(1, "Otros", None)])
    deaths = rows("id_mortalidad int, id_animal int, fecha_muerte date, id_causa int, observacion string, id_usuario int",
                  [(i, 1, day, 1, f"o{i}", 1) for i in ids])
    got = R.mortalidad(deaths, animal, raza, cause, user).collect()
    assert [r.id_mortalidad for r in got] == sorted(ids) and got[0].observacion == "o1"
    audit = rows("id_auditoria int, id_alerta int, modulo string, id_animal int, tipo string, prioridad string, "
                 "fecha_programada date, estado_anterior string, estado_nuevo string, accion_auditoria string, "
                 "fecha_auditoria date, usuario_auditor string",
                 [(i, 1, "m", 1, "t", "p", day, "x", "y", "z", day, "u") for i in ids])
    assert [r.id_auditoria for r in R.auditoria_alertas(audit, animal).collect()] == sorted(ids)
    cycles = rows("id_ciclo int, id_animal int, fecha_inicio date, tipo_evento string, estado_ciclo string, "
                  "fecha_palpacion1 date, resultado_palpacion1 string, fecha_palpacion2 date, "
                  "resultado_palpacion2 string, fecha_parto_real date, resultado_parto string",
                  [(i, 1, day, "e", "c", day, "p", None, None, None, None) for i in ids])
    assert [r.id_ciclo for r in R.historial_reproductivo(cycles, animal).collect()] == sorted(ids)
    alerts = rows("id_alerta int, id_animal int, tipo_alerta string, fecha_programada date, estado_alerta string",
                  [(i, 1, "t", day, "Pendiente") for i in ids])
    assert [r.id_alerta for r in R.proximos_eventos(alerts, animal, "2024-01-01").collect()] == sorted(ids)
    stock = rows("id_insumo int, nombre string, unidad string, stock_actual decimal(10,2), stock_minimo decimal(10,2), activo boolean",
                 [(i, "n", "kg", Decimal(1), Decimal(2), True) for i in ids])
    assert [r.id_insumo for r in R.stock_bajo(stock).collect()] == sorted(ids)


def test_a_month_beyond_eighteen_digits(rows):
    big = rows("fecha_transaccion date, categoria string, monto decimal(38,2)",
               [(D(2024, 1, 1), "ingreso", Decimal(10**20)), (D(2024, 1, 2), "ingreso", Decimal(10**20)), (D(2024, 1, 2), "gasto", Decimal(1))])
    got = R.resumen_financiero_mensual(big).first()
    assert got.total_ingresos == 2 * 10**20 and got.balance == 2 * 10**20 - 1
