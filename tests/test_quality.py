"""Duplicate keys, key renames and cascading deletes."""

import random
from collections import Counter
from datetime import date

from hatospark.model.tables import TABLES
from hatospark.operators import quality as Q
from hatospark.plans.quality import _shares


def _source(spark, pens):
    def source(name):
        fields = ", ".join(f"{c.name} {c.type.simpleString()}" for c in TABLES[name].columns)
        data = [tuple([p] + [None] * (len(TABLES[name].columns) - 1)) for p in pens] if name == "tbl_manga" else []
        return spark.createDataFrame(data, fields)

    return source


def _renamed(spark, rows, pens, renames):
    out = Q.rename_keys(_source(spark, pens), "tbl_manga", rows("old int, new int", renames))
    keys = sorted(r.id_manga for r in out["tbl_manga"].collect())
    return keys, sorted(r[0] for r in out["bloqueados"].collect())


def test_keys_stay_unique(spark, rows):
    assert _renamed(spark, rows, [1, 2, 3], [(1, 2)]) == ([1, 2, 3], [1])
    assert _renamed(spark, rows, [1, 2, 3], [(1, 8), (1, 9), (3, 7)]) == ([1, 2, 7], [1])
    assert _renamed(spark, rows, [1, 2, 3], [(1, 9), (2, 9)]) == ([1, 2, 3], [1, 2])
    assert _renamed(spark, rows, [1, 2], [(1, 2), (2, 1)]) == ([1, 2], [])
    # A chain whose last link is blocked is blocked as a whole.
    assert _renamed(spark, rows, [1, 2, 3, 4], [(1, 2), (2, 3), (3, 4)]) == ([1, 2, 3, 4], [1, 2, 3])


def _blocked(pens, renames):
    """Brute force: follow the renames until none is blocked any more."""
    moving, blocked = dict(renames), set()
    while True:
        more = {o for o, n in moving.items() if n in pens and n not in moving}
        if not more:
            return sorted(blocked)
        blocked |= more
        moving = {o: n for o, n in moving.items() if o not in more}


def _blocked_down(rows, pens, renames):
    out = Q._blocked_down(rows("old int, new int", renames), rows("new int", [(p,) for p in pens]))
    return sorted(r.old for r in out.collect())


def test_random_renames(rows):
    rng = random.Random(1)
    for n in (6, 12, 40):
        pens = rng.sample(range(n), rng.randint(n // 2, n))
        olds, news = rng.sample(range(n), n // 2), rng.sample(range(n + 3), n // 2)
        renames = [(o, m) for o, m in zip(olds, news) if o != m]
        assert _blocked_down(rows, pens, renames) == _blocked(set(pens), renames)


def test_chain_of_ten_thousand_renames(rows, monkeypatch):
    """A blocked chain, a free one and a ring; pointers double, so few rounds are written."""
    n, written, checkpoint = 10_000, [], Q.checkpoint
    monkeypatch.setattr(Q, "checkpoint", lambda df: written.append(1) or checkpoint(df))
    chain = [(i, i + 1) for i in range(n)]  # the last one meets key n, which stays
    free = [(i, i + 1) for i in range(2 * n, 3 * n)]
    ring = [(4 * n + i, 4 * n + (i + 1) % 100) for i in range(100)]
    pens = [*range(n + 1), *range(2 * n, 3 * n), *range(4 * n, 4 * n + 100)]
    assert _blocked_down(rows, pens, chain + free + ring) == list(range(n))
    assert len(written) < 20


def _filled(spark, data):
    """Tables with the given columns of some rows; all other columns are null."""

    def source(name):
        fields = TABLES[name].columns
        given = [tuple(r.get(c.name) for c in fields) for r in data.get(name, [])]
        return spark.createDataFrame(given, ", ".join(f"{c.name} {c.type.simpleString()}" for c in fields))

    return source


def test_cascade_closes_over_two_levels(spark, rows):
    """Animals 1 to 3 are to go: 2 is held by a cycle; 3 is the mother of a calf, which loses the reference."""
    source = _filled(spark, {
        "tbl_animal": [{"id_animal": i} for i in (1, 2, 3, 4)],
        "tbl_toro_detalle": [{"id_toro_detalle": 10 * i, "id_animal": i} for i in (1, 2, 4)],
        "tbl_toro_inseminacion": [{"id_inseminacion": 100 * i, "id_toro_detalle": 10 * i} for i in (1, 2, 4)],
        "tbl_ternero_detalle": [{"id_ternero_detalle": 7, "id_animal": 4, "id_madre": 3}],
        "tbl_pesaje": [{"id_pesaje": i, "id_animal": i % 4 + 1} for i in range(8)],
        "tbl_ciclo_reproductivo": [{"id_ciclo": 5, "id_animal": 2}],
        "tbl_alerta": [{"id_alerta": 6, "id_animal": 1}],
        "tbl_auditoria_alerta": [{"id_auditoria": 8, "id_alerta": 6, "id_animal": 1}],
    })
    out = Q.delete_rows(source, "tbl_animal", rows("k int", [(1,), (2,), (3,), (9,)]))
    left = {n: sorted(r[0] for r in out[n].select(TABLES[n].key).collect()) for n in out if n != "bloqueados"}
    assert sorted(r[0] for r in out["bloqueados"].collect()) == [2]
    assert left["tbl_animal"] == [2, 4] and left["tbl_toro_detalle"] == [20, 40]
    assert left["tbl_toro_inseminacion"] == [200, 400] and left["tbl_pesaje"] == [1, 3, 5, 7]
    assert left["tbl_alerta"] == [] and left["tbl_ternero_detalle"] == [7]
    assert out["tbl_ternero_detalle"].first().id_madre is None
    # The closure is written, so an output joins its table with it once.
    plan = out["tbl_toro_inseminacion"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def _duplicates(spark, data, shares):
    given = {name: list(rows[0]) for name, rows in data.items()}
    return Q.duplicate_keys(_filled(spark, data), lambda table: given.get(table, []), shares)


def test_duplicate_keys(spark):
    data = {
        # Key 7 three times, null never; the pair (3, day) twice; a name by the collation.
        "tbl_produccion_leche": [
            {"id_produccion": k, "id_animal": a, "fecha_ordeno": d and date(2020, 1, d)}
            for k, a, d in [(7, 3, 1), (7, 3, 1), (7, 3, 2), (None, 3, None), (None, None, 2), (8, None, 2)]
        ],
        "tbl_registro_sanitario_animal": [
            {"id_detalle": i % 1000, "id_registro_san": i % 1000 // 3, "id_animal": i % 3} for i in range(2000)
        ],
        "tbl_rol": [{"id_rol": 1, "nombre_rol": "Peón"}, {"id_rol": 2, "nombre_rol": "peon "}],
    }
    expected = {
        ("tbl_produccion_leche", "id_produccion", "7", 3),
        ("tbl_produccion_leche", "id_animal+fecha_ordeno", "3|2020-01-01", 2),
        ("tbl_rol", "nombre_rol", "Peón", 2),
    }
    pairs = Counter((i % 1000 // 3, i % 3) for i in range(2000))
    for k in range(1000):
        expected.add(("tbl_registro_sanitario_animal", "id_detalle", str(k), 2))
    for r, a in (pair for pair, n in pairs.items() if n > 1):
        expected.add(("tbl_registro_sanitario_animal", "id_registro_san+id_animal", f"{r}|{a}", pairs[r, a]))
    for shares in (1, 5, 200):
        found = [tuple(r) for r in _duplicates(spark, data, shares).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_number_keys_are_dealt_before_they_are_counted(spark):
    """Tasks that read rows hold none of their keys: they go to their shares uncounted, and no further."""
    data = {
        "tbl_pesaje": [{"id_pesaje": i // 2} for i in range(10)],
        "tbl_mortalidad": [{"id_mortalidad": i, "id_animal": i // 2} for i in range(10)],
        "tbl_rol": [{"nombre_rol": "Peón"}],
    }
    plan = _duplicates(spark, data, 5)._jdf.queryExecution().executedPlan().toString()
    by_number, by_text = plan.split("SortAggregate", 1)
    assert by_number.count("Exchange") == 1 and "REPARTITION_BY_NUM" in by_number
    counted, dealt = by_number.split("Exchange")
    assert "HashAggregate" in counted and "Aggregate" not in dealt
    assert "SortAggregate" in by_text.split("Exchange")[1]


def test_shares_grow_with_the_rows():
    """Never more than can be written without sorting in memory."""
    assert [_shares(rows, 8) for rows in (0, 1_000_000, 5_000_000, 10**10)] == [8, 8, 20, 200]
    assert _shares(0, 500) == 200
