"""Reports kept by signed deltas equal the reports over the whole tables."""

import datetime as dt
import random
from decimal import Decimal

from hatospark.operators import maintenance as M
from hatospark.operators import reports as R

TX = "id_transaccion long, fecha_transaccion date, categoria string, monto decimal(12,2)"
ANIMAL = "id_animal long, id_manga_actual int, estado_animal string"
MANGA = "id_manga int, numero_manga int, nombre string, funcion string, capacidad_max int"
CICLO = "id_ciclo long, estado_ciclo string, resultado_parto string, fecha_parto_real date"


def _batches(rng, make, n=200):
    """Rows before, and batches of (new rows, replaced or deleted rows); the last state."""
    state = {i: make(rng, i) for i in range(n)}
    first, batches = list(state.values()), []
    for _ in range(3):
        old, new = [], []
        for i in rng.sample(sorted(state), 40):
            old.append(state.pop(i))
            if rng.random() < 0.7:
                state[i] = make(rng, i)
                new.append(state[i])
        for i in range(max(state) + 1, max(state) + 11):
            state[i] = make(rng, i)
            new.append(state[i])
        batches.append((new, old))
    return first, batches, list(state.values())


def _kept(rows, schema, groups, first, batches):
    kept = groups(M.signed(rows(schema, first)))
    for new, old in batches:
        kept = M.merged(kept, groups(M.signed(rows(schema, new), rows(schema, old))))
    return kept


def _same(got, want):
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.collect() == want.collect()


def test_monthly_summary(rows):
    def make(rng, i):
        day = dt.date(2024, rng.randint(1, 3), 5) if i % 50 else dt.date(2020 + i // 50, 1, 1)
        return (i, day, rng.choice(["ingreso", "gasto", "otro"]), Decimal(rng.randint(0, 10**6)) / 100)

    first, batches, last = _batches(random.Random(1), make)
    kept = _kept(rows, TX, M.importes, first, batches)
    _same(M.resumen_de(kept), R.resumen_financiero_mensual(rows(TX, last)))


def test_a_group_without_rows_goes(rows):
    row = (1, dt.date(2024, 1, 1), "ingreso", Decimal(5))
    kept = M.merged(M.importes(M.signed(rows(TX, [row]))), M.importes(M.signed(rows(TX), rows(TX, [row]))))
    assert kept.collect() == []


def test_pens(rows):
    def make(rng, i):
        return (i, rng.choice([None, 1, 2, 3]), rng.choice(["Activo", "Activo", "Vendido", "Fallecido"]))

    first, batches, last = _batches(random.Random(2), make)
    manga = rows(MANGA, [(i, i, f"m{i}", "f", 40 if i else 0) for i in range(5)])
    got = M.inventario_de(_kept(rows, ANIMAL, M.cabezas, first, batches), manga)
    _same(got.orderBy("id_manga"), R.inventario_mangas(manga, rows(ANIMAL, last)).orderBy("id_manga"))


def test_indicators(rows):
    states = ["Preñez Provisional", "Preñez Confirmada", "Parto Exitoso", "Vacía", "Abortado"]

    def make(rng, i):
        day = rng.choice([None, dt.date(2024, 5, 3), dt.date(2024, 6, 7)])
        return (i, rng.choice(states), rng.choice([None, "Exitoso", "Abortado"]), day)

    first, batches, last = _batches(random.Random(3), make)
    kept = _kept(rows, CICLO, M.fases, first, batches)
    _same(M.kpi_de(kept, "2024-06-20"), R.kpi_reproductivo(rows(CICLO, last), "2024-06-20"))
    none = M.fases(M.signed(rows(CICLO)))
    _same(M.kpi_de(none, "2024-06-20"), R.kpi_reproductivo(rows(CICLO), "2024-06-20"))


def test_low_stock(rows):
    schema = "id_insumo int, nombre string, unidad string, activo boolean, stock_actual decimal(10,2), stock_minimo decimal(10,2)"
    rng = random.Random(4)
    make = lambda i: (i, f"n{i}", "kg", rng.random() < 0.8, Decimal(rng.randint(0, 20)), Decimal(10))
    before = [make(i) for i in range(40)]
    changed = [make(i) for i in range(10, 50)]
    after = before[:10] + changed
    _same(M.stock_bajo_tras(R.stock_bajo(rows(schema, before)), rows(schema, changed)), R.stock_bajo(rows(schema, after)))
