"""Golden cases of the batch commands."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from hatospark.operators import commands as P

D = dt.date


def test_causes_match_without_case_accents_or_trailing_blanks(rows):
    causa = rows("id_causa int, causa_principal string, detalle_causa string",
                 [(1, "Digestivo", "Timpánico"), (2, "Digestivo", "timpanico"), (3, "Otros", None)])
    asked = rows("seq long, principal string, detalle string", [
        (1, "DIGESTIVO", "TIMPANICO  "), (2, "Otros", None), (3, "Diarrea", "Viral"), (4, "Diarrea", "víral "),
        (5, "Diarrea", None), (6, "Fiebre", "x")])
    got = P.resolver_causas(causa, asked)
    assert {r.seq: r.id_causa for r in got["resueltas"].collect()} == {1: 1, 2: 3, 3: 4, 4: 4, 5: 5}
    assert {(r.id_causa, r.detalle_causa) for r in got["tbl_causa"].collect()} == {(4, "Viral"), (5, None)}
    assert [r.seq for r in got["rechazadas"].collect()] == [6]


def test_clashes_follow_request_order(rows):
    rng = random.Random(4)
    data = [(i, f"a{rng.randint(0, 30)}", f"b{rng.randint(0, 30)}") for i in range(45)]
    taken_a, taken_b, lost = set(), set(), set()
    for seq, a, b in data:
        if a in taken_a or b in taken_b:
            lost.add(seq)
        else:
            taken_a.add(a)
            taken_b.add(b)
    got = P.clashes(rows("seq long, a string, b string", data), ["a", "b"])
    assert {r.seq for r in got.collect()} == lost
    assert P.clashes(rows("seq long, a string, b string", [(1, "x", "y"), (2, "z", "w")]), ["a", "b"]) is None


def _greedy(data):
    """Brute force: requests in order, each one gets its keys if both are free."""
    held, lost = set(), []
    for seq, a, b in sorted(data):
        if ("a", a) in held or ("b", b) in held:
            lost.append(seq)
        else:
            held |= {("a", a), ("b", b)}
    return lost


def _lost(rows, data):
    found = P.clashes(rows("seq long, a string, b string", data), ["a", "b"])
    return [] if found is None else sorted(r.seq for r in found.collect())


@pytest.mark.parametrize("folded", [3, 8192])
def test_clashes_against_brute_force(rows, monkeypatch, folded):
    """Few keys for many requests, a key that a third of them claim; large components go in parts."""
    monkeypatch.setattr(P, "FOLDED", folded)
    rng = random.Random(folded)
    seqs = rng.sample(range(10**6), 60)
    data = [(s, "hot" if rng.random() < 0.3 else f"a{rng.randrange(25)}", f"b{rng.randrange(30)}") for s in seqs]
    assert _lost(rows, data) == _greedy(data)


def test_chain_of_ten_thousand_claims(rows, monkeypatch):
    """Each request shares one key with the one before: every second one loses, in few written steps."""
    written, checkpoint = [], P.checkpoint
    monkeypatch.setattr(P, "checkpoint", lambda df: written.append(1) or checkpoint(df))
    data = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(10_000)]
    assert _lost(rows, data) == list(range(1, 10_000, 2)) == _greedy(data)
    assert len(written) <= 13

def test_period_totals_match_brute_force(rows):
    rng = random.Random(1)
    start = D(2019, 12, 20)
    daily = {start + dt.timedelta(i): Decimal(rng.randint(0, 50)) for i in rng.sample(range(900), 500)}
    periods = []
    for seq in range(60):
        a = start + dt.timedelta(rng.randint(-40, 900))
        periods.append((seq, a, a + dt.timedelta(rng.choice([-3, 0, 1, 15, 31, 59, 365, 800]))))
    periods += [(60, D(2020, 1, 1), D(2020, 12, 31)), (61, D(2020, 2, 1), D(2020, 2, 29))]
    got = P.period_totals(
        rows("seq long, fecha_inicio date, fecha_fin date", periods),
        rows("dia date, litros decimal(12,2)", daily.items()),
    )
    got = {r.seq: r.litros for r in got.collect()}
    for seq, a, b in periods:
        assert got.get(seq, 0) == sum(v for d, v in daily.items() if a <= d <= b), (a, b)


def test_milk_settlement_refuses_empty_periods_and_negative_net(rows):
    leche = rows("fecha_ordeno date, total_litros decimal(6,2)", [(D(2024, 1, 5), Decimal("10.00"))])
    asked = rows(
        "seq long, fecha_inicio date, fecha_fin date, precio_litro decimal(8,4), descuentos decimal(12,2), "
        "comprador string, notas string, id_usuario int",
        [(1, D(2024, 1, 1), D(2024, 1, 5), Decimal("0.4525"), Decimal("1.00"), None, None, 1),
         (2, D(2024, 1, 6), D(2024, 1, 31), Decimal("1.0000"), Decimal("0.00"), "x", None, 1),
         (3, D(2024, 1, 5), D(2024, 1, 5), Decimal("1.0000"), Decimal("11.00"), "x", None, 1)])
    got = P.liquidar_leche(asked, leche, rows("id_transaccion long", [(8,)]), rows("id_usuario int", [(1,)]))
    [entry] = got["tbl_transaccion_financiera"].collect()
    assert (entry.id_transaccion, entry.monto) == (9, Decimal("3.53"))
    assert entry.descripcion == "10.00 lts × $0.4525 | Comprador: N/A"
    assert {r.seq: r.motivo for r in got["rechazadas"].collect()} == {
        2: "No hay registros de producción en el período indicado", 3: "ingreso neto negativo"}


def test_milk_settlement_refuses_what_does_not_fit_and_settles_the_rest(rows):
    asked = rows(
        "seq long, fecha_inicio date, fecha_fin date, precio_litro decimal(18,4), descuentos decimal(12,2), "
        "comprador string, notas string, id_usuario int",
        [
            (1, D(2024, 1, 1), D(2024, 1, 31), Decimal(1), Decimal(0), None, None, 1),
            (2, D(2024, 2, 1), D(2024, 2, 28), Decimal(2), Decimal(1), None, None, 1),
            (3, D(2024, 2, 1), D(2024, 2, 28), Decimal(10**9), Decimal(0), None, None, 1),
            (4, D(2024, 2, 1), D(2024, 2, 28), Decimal(2), Decimal(1), None, None, 99),
        ],
    )
    milk = rows(
        "fecha_ordeno date, total_litros decimal(12,2)",
        [(D(2024, 1, 5), Decimal(99_999_999)), (D(2024, 1, 6), Decimal(2)), (D(2024, 2, 2), Decimal(50))],
    )
    out = P.liquidar_leche(
        asked, milk, rows("id_transaccion long", [(4,)]), rows("id_usuario int", [(1,)])
    )
    assert [(r.id_transaccion, r.monto) for r in out["tbl_transaccion_financiera"].collect()] == [(5, Decimal(99))]
    assert {r.seq: r.motivo for r in out["rechazadas"].collect()} == {
        1: "litros fuera de rango", 3: "importe fuera de rango", 4: "usuario inexistente",
    }


def test_sale_income_checks_the_user(rows):
    asked = rows(
        "seq long, id_baja long, precio decimal(14,2), comision_pct decimal(5,2), notas string, id_usuario int",
        [(1, 1, Decimal(10), Decimal(1), None, 1), (2, 1, Decimal(10), Decimal(1), None, 9),
         (3, 1, Decimal(10**11), Decimal(1), None, 1), (4, 1, Decimal(5), Decimal(1), None, None)],
    )
    out = P.ingreso_venta_animal(
        asked,
        rows("id_baja long, id_animal int, fecha_baja date, comprador string", [(1, 1, D(2024, 1, 1), None)]),
        rows("id_animal int, arete string", [(1, "a")]),
        rows("id_transaccion long"),
        rows("id_usuario int", [(1,)]),
    )
    assert {r.seq: r.motivo for r in out["rechazadas"].collect()} == {
        2: "usuario inexistente", 3: "importe fuera de rango",
    }
    assert [r.id_transaccion for r in out["tbl_transaccion_animal"].collect()] == [1, 2]
