"""A mixed batch of cycle commands against a plain sequential run."""

import datetime as dt
import random

from hatospark.operators.cycles import NEEDS, reproducir_ciclos

TODAY = dt.date(2024, 6, 1)
DAY = dt.timedelta(1)
CYCLE = [
    "id_ciclo", "id_animal", "fecha_inicio", "tipo_evento", "id_veterinario_inicio", "fecha_estimada_palp1",
    "fecha_estimada_palp2", "fecha_estimada_parto", "estado_ciclo", "fecha_palpacion1", "resultado_palpacion1",
    "id_veterinario_palp1", "fecha_palpacion2", "resultado_palpacion2", "id_veterinario_palp2",
    "fecha_parto_real", "resultado_parto", "id_veterinario_parto",
]
SCHEMA = ", ".join(
    f"{c} " + ("date" if c.startswith("fecha") else "long" if c.startswith("id") else "string") for c in CYCLE
)
KINDS = ("Monta Natural", "Inseminación Artificial")


def make(seed):
    rng = random.Random(seed)
    cycles, alerts, orders = [], [], []
    for i in range(1, 26):
        start = dt.date(2023, 1, 1) + rng.randint(0, 300) * DAY
        c = dict.fromkeys(CYCLE)
        c.update(id_ciclo=i, id_animal=rng.randint(1, 8), fecha_inicio=start, tipo_evento=rng.choice(KINDS),
                 fecha_estimada_palp1=start + 30 * DAY, fecha_estimada_palp2=start + 60 * DAY,
                 fecha_estimada_parto=start + 283 * DAY, id_veterinario_inicio=1)
        level = rng.choice([0, 0, 0, 1, 1, 2, 3, 4])
        c["estado_ciclo"] = ["Pendiente Palpación 1", "Preñez Provisional", "Preñez Confirmada", "Parto Exitoso", "Vacía"][level]
        if level >= 1:
            c.update(fecha_palpacion1=rng.choice([None, start + 30 * DAY]), resultado_palpacion1=rng.choice(["Preñada", None]))
        if level in (2, 3):
            c.update(fecha_palpacion2=start + 60 * DAY, resultado_palpacion2="Preñada")
        if level == 3:
            c.update(fecha_parto_real=start + 280 * DAY, resultado_parto="Exitoso")
        cycles.append(c)
        for kind in ("Palpación 1", "Palpación 2", "Parto Estimado", "Seguimiento de Celo"):
            if rng.random() < 0.5:
                alerts.append([len(alerts) + 1, i, c["id_animal"], kind, start, rng.choice(["Pendiente", "Cancelada"])])
    seqs = rng.sample(range(5000), 700)
    for seq in seqs:
        name = rng.choice([*NEEDS, "iniciar_ciclo"])
        hot = rng.random() < 0.3
        i = 1 if hot else rng.randint(1, 27)
        base = cycles[(i - 1) % 25]["fecha_inicio"]
        fecha = rng.choice([None, base - 3 * DAY, *(base + n * DAY for n in (0, 30, 31, 60, 62, 64, 280, 284, 900))])
        result = rng.choice(["Exitoso", "Abortado", "Dudoso"] if "parto" in name else ["Preñada", "Preñada", "Preñada", "Vacía", "Dudosa"])
        orders.append(dict(seq=seq, orden=name, id_ciclo=i, id_animal=rng.randint(1, 9), id_usuario=rng.randint(1, 3),
                           fecha=fecha, resultado=result, tipo_evento=rng.choice([*KINDS, "Otro"] if rng.random() < 0.2 else KINDS),
                           id_veterinario=rng.choice([None, 1, 2, 2, 99])))
    return cycles, alerts, sorted(orders, key=lambda o: o["seq"])


class Refused(Exception):
    pass


def run(cycles, alerts, orders):
    """One command after the other, as a person reading the rules would apply them."""
    cycles = {c["id_ciclo"]: dict(c) for c in cycles}
    alerts = [list(a) for a in alerts]
    new_cycles, new_alerts, audits, refused, cow = [], [], [], set(), {}

    def pending(cycle, kinds):
        old = [a for a in alerts if a[1] == cycle and a[3] in kinds and a[5] == "Pendiente"]
        return old + [a for a in new_alerts if a[1] == cycle and a[3] in kinds and a[5] == "Pendiente"]

    def move(c, state):
        old, c["estado_ciclo"] = c["estado_ciclo"], state
        cow[c["id_animal"]] = "Preñada" if state.startswith("Preñez") else "Vacía"
        done = {"Pendiente Palpación 1": "Palpación 1", "Preñez Provisional": "Palpación 2"}.get(old)
        if old == "Preñez Confirmada" and state != "Vacía":
            done = "Parto Estimado"
        for a in pending(c["id_ciclo"], [done]):
            a[5] = "Completada"

    def alert(o, c, kind, day):
        new_alerts.append([o["seq"], c["id_ciclo"], c["id_animal"], kind, day, "Pendiente"])

    def audit(o, c, phase, field, old, new, cascade):
        audits.append((c["id_ciclo"], o["id_usuario"], phase, field, str(old), str(new), cascade))

    def apply(o):
        name, f, res, vet = o["orden"], o["fecha"], o["resultado"], o["id_veterinario"]
        known_vet = vet in (None, 1, 2)
        if name == "iniciar_ciclo":
            mine = [c for c in cycles.values() if c["id_animal"] == o["id_animal"]] + [
                c for c in new_cycles if c["id_animal"] == o["id_animal"]]
            if any(c["estado_ciclo"] not in ("Parto Exitoso", "Abortado", "Vacía") for c in mine):
                raise Refused
            if f is None or o["tipo_evento"] == "Otro" or not known_vet or o["id_animal"] == 9:
                raise Refused
            c = dict.fromkeys(CYCLE)
            c.update(seq=o["seq"], id_ciclo=None, id_animal=o["id_animal"], fecha_inicio=f, tipo_evento=o["tipo_evento"],
                     id_veterinario_inicio=vet, estado_ciclo="Pendiente Palpación 1",
                     fecha_estimada_palp1=f + 30 * DAY, fecha_estimada_palp2=f + 60 * DAY, fecha_estimada_parto=f + 283 * DAY)
            new_cycles.append(c)
            new_alerts.append([o["seq"], ("new", o["seq"]), o["id_animal"], "Palpación 1", f + 30 * DAY, "Pendiente"])
            return
        c = cycles.get(o["id_ciclo"])
        if c is None:
            raise Refused
        state, i = c["estado_ciclo"], c["id_ciclo"]
        if name == "editar_servicio":
            if state != "Pendiente Palpación 1" or f is None or f > TODAY or o["tipo_evento"] == "Otro" or not known_vet:
                raise Refused
            old, old_kind = c["fecha_inicio"], c["tipo_evento"]
            c.update(fecha_inicio=f, tipo_evento=o["tipo_evento"], id_veterinario_inicio=vet,
                     fecha_estimada_palp1=f + 30 * DAY, fecha_estimada_palp2=f + 60 * DAY, fecha_estimada_parto=f + 283 * DAY)
            if old != f:
                for a in pending(i, ["Palpación 1"]):
                    a[4] = f + 30 * DAY
                audit(o, c, "Servicio", "fecha_inicio", old, f, True)
            if old_kind != o["tipo_evento"]:
                audit(o, c, "Servicio", "tipo_evento", old_kind, o["tipo_evento"], False)
        elif name in ("registrar_palpacion1", "registrar_palpacion2"):
            n = name[-1]
            if state != ("Pendiente Palpación 1" if n == "1" else "Preñez Provisional") or res == "Dudosa":
                raise Refused
            if not known_vet or (f and f < c["fecha_inicio"]):
                raise Refused
            c.update({f"fecha_palpacion{n}": f, f"resultado_palpacion{n}": res, f"id_veterinario_palp{n}": vet})
            if res == "Vacía":
                move(c, "Vacía")
                alert(o, c, "Seguimiento de Celo", TODAY + 21 * DAY)
            elif n == "1":
                move(c, "Preñez Provisional")
                alert(o, c, "Palpación 2", c["fecha_estimada_palp2"])
            else:
                move(c, "Preñez Confirmada")
                alert(o, c, "Parto Estimado", c["fecha_estimada_parto"])
        elif name == "registrar_parto":
            if state != "Preñez Confirmada" or res == "Dudoso" or not known_vet or (f and f < c["fecha_inicio"]):
                raise Refused
            c.update(fecha_parto_real=f, resultado_parto=res, id_veterinario_parto=vet)
            move(c, "Parto Exitoso" if res == "Exitoso" else "Abortado")
            if res == "Abortado":
                alert(o, c, "Seguimiento de Celo", TODAY + 21 * DAY)
        elif name == "editar_palpacion1":
            if state != "Preñez Provisional" or (f and (f < c["fecha_inicio"] or f > TODAY)) or not known_vet:
                raise Refused
            old, old_res = c["fecha_palpacion1"], c["resultado_palpacion1"]
            if old_res == "Preñada" and res == "Vacía":
                c.update(resultado_palpacion1=res, fecha_palpacion1=f, id_veterinario_palp1=vet)
                move(c, "Vacía")
                for a in pending(i, ["Palpación 2", "Parto Estimado"]):
                    a[5] = "Cancelada"
                alert(o, c, "Seguimiento de Celo", TODAY + 21 * DAY)
                audit(o, c, "Palpación 1", "resultado_palpacion1", old_res, res, True)
            elif f and old and f != old:
                c.update(fecha_palpacion1=f, id_veterinario_palp1=vet, fecha_estimada_palp2=f + 30 * DAY)
                for a in pending(i, ["Palpación 2"]):
                    a[4] = f + 30 * DAY
                audit(o, c, "Palpación 1", "fecha_palpacion1", old, f, True)
            else:
                c.update(id_veterinario_palp1=vet)
        elif name == "editar_palpacion2":
            p1 = c["fecha_palpacion1"]
            if state != "Preñez Confirmada" or (f and ((p1 and f < p1) or f > TODAY or f < c["fecha_inicio"])):
                raise Refused
            old, old_res = c["fecha_palpacion2"], c["resultado_palpacion2"]
            if old_res == "Preñada" and res == "Vacía":
                c.update(resultado_palpacion2=res, fecha_palpacion2=f)
                move(c, "Vacía")
                for a in pending(i, ["Parto Estimado"]):
                    a[5] = "Cancelada"
                alert(o, c, "Seguimiento de Celo", TODAY + 21 * DAY)
                audit(o, c, "Palpación 2", "resultado_palpacion2", old_res, res, True)
            elif f and old and f != old:
                c.update(fecha_palpacion2=f)
                audit(o, c, "Palpación 2", "fecha_palpacion2", old, f, False)
        else:
            p2 = c["fecha_palpacion2"]
            if state not in ("Parto Exitoso", "Abortado") or (f and ((p2 and f < p2) or f > TODAY)):
                raise Refused
            old = c["resultado_parto"]
            if (old, res) == ("Exitoso", "Abortado"):
                if f is None:
                    raise Refused
                c.update(resultado_parto=res)
                move(c, "Abortado")
                alert(o, c, "Seguimiento de Celo", f + 21 * DAY)
                audit(o, c, "Parto", "resultado_parto", old, res, True)
            elif (old, res) == ("Abortado", "Exitoso"):
                c.update(resultado_parto=res)
                move(c, "Parto Exitoso")
                for a in pending(i, ["Seguimiento de Celo"]):
                    a[5] = "Cancelada"
                audit(o, c, "Parto", "resultado_parto", old, res, True)

    for o in orders:
        try:
            apply(o)
        except Refused:
            refused.add(o["seq"])
    for n, c in enumerate(new_cycles):
        c["id_ciclo"] = 25 + n + 1
    ids = {("new", c["seq"]): c["id_ciclo"] for c in new_cycles}
    for n, a in enumerate(sorted(new_alerts, key=lambda a: a[0])):
        alerts.append([len(alerts) + 1, ids.get(a[1], a[1]), *a[2:]])
    return [*cycles.values(), *new_cycles], alerts, audits, refused, cow


def test_replay_matches_a_sequential_run(rows):
    for seed in (3,):
        cycles, alerts, orders = make(seed)
        want_cycles, want_alerts, want_audits, want_refused, want_cow = run(cycles, alerts, orders)
        fields = "seq long, id_ciclo long, id_usuario long, fecha date, resultado string, tipo_evento string, id_veterinario long"
        names = [f.split()[0] for f in fields.split(", ")]
        by_name = {
            n: rows(fields, [tuple(o[c] for c in names) for o in orders if o["orden"] == n]) for n in NEEDS
        }
        starts = rows(
            "seq long, id_animal long, fecha_inicio date, tipo_evento string, id_veterinario long",
            [(o["seq"], o["id_animal"], o["fecha"], o["tipo_evento"], o["id_veterinario"])
             for o in orders if o["orden"] == "iniciar_ciclo"],
        )
        got = reproducir_ciclos(
            rows(SCHEMA, [tuple(c[k] for k in CYCLE) for c in cycles]),
            rows("id_alerta long, id_ciclo long, id_animal long, tipo_alerta string, fecha_programada date, estado_alerta string",
                 [tuple(a) for a in alerts]),
            rows("id_vaca_detalle long, id_animal long, estado_reproductivo string, es_vigente boolean",
                 [(i, i, "Seca", i != 8) for i in range(1, 9)]),
            rows("id_colaborador long", [(1,), (2,)]),
            by_name,
            TODAY.isoformat(),
            inicios=starts,
            animal=rows("id_animal long", [(i,) for i in range(1, 9)]),
        )
        assert {r.seq for r in got["rechazadas"].collect()} == want_refused
        key = str
        assert sorted((tuple(r[c] for c in CYCLE) for r in got["tbl_ciclo_reproductivo"].collect()), key=key) == sorted(
            (tuple(c[k] for k in CYCLE) for c in want_cycles), key=key)
        assert sorted(map(tuple, got["tbl_alerta_reproductiva"].collect())) == sorted(map(tuple, want_alerts))
        audits = [tuple(r)[:6] + (r.genero_cascada,) for r in got["tbl_auditoria_ciclo"].collect()]
        assert sorted(audits, key=key) == sorted(want_audits, key=key)
        for r in got["tbl_vaca_detalle"].collect():
            assert r.estado_reproductivo == ("Seca" if r.id_animal == 8 else want_cow.get(r.id_animal, "Seca"))
        assert len(want_refused) < len(orders) and want_audits and len(want_cycles) > 25


def test_a_batch_is_read_once_for_all_phases(rows, tmp_path):
    cycles, alerts, orders = make(5)
    fields = "seq long, id_ciclo long, id_usuario long, fecha date, resultado string, tipo_evento string, id_veterinario long"
    names = [f.split()[0] for f in fields.split(", ")]
    requests = rows(f"{fields}, orden string", [tuple(o[c] for c in [*names, "orden"]) for o in orders])
    requests.write.parquet(str(tmp_path / "lote"))
    requests = requests.sparkSession.read.parquet(str(tmp_path / "lote"))
    repeated = max(cycles, key=lambda c: (c["estado_ciclo"] == "Vacía", c["id_ciclo"]))
    cycle_rows = rows(SCHEMA, [tuple(c[k] for k in CYCLE) for c in [*cycles, repeated]])
    rest = (
        rows("id_alerta long, id_ciclo long, id_animal long, tipo_alerta string, fecha_programada date, estado_alerta string",
             [tuple(a) for a in alerts]),
        rows("id_vaca_detalle long, id_animal long, estado_reproductivo string, es_vigente boolean",
             [(i, i, "Seca", True) for i in range(1, 9)]),
        rows("id_colaborador long", [(1,), (2,)]),
    )
    by_name = {n: requests.filter(f"orden = '{n}'") for n in NEEDS}
    got, same = (reproducir_ciclos(cycle_rows, *rest, o, TODAY.isoformat()) for o in (by_name, requests))
    for name in got:
        assert sorted(map(str, got[name].collect())) == sorted(map(str, same[name].collect()))
    for name in ("tbl_ciclo_reproductivo", "tbl_vaca_detalle", "tbl_auditoria_ciclo"):
        assert not [f for f in got[name].inputFiles() if "/lote/" in f]
    # Refused once for each row of the cycle, and once where there is none.
    seqs = [r.seq for r in got["rechazadas"].collect()]
    for o in orders:
        if o["orden"] in NEEDS and o["id_ciclo"] == repeated["id_ciclo"]:
            assert seqs.count(o["seq"]) == 2
        elif o["orden"] in NEEDS:
            assert seqs.count(o["seq"]) <= 1


def test_an_id_in_rows_of_several_states_takes_part_in_full(rows):
    cycles, _, _ = make(5)
    first = next(c for c in cycles if c["estado_ciclo"] == "Pendiente Palpación 1")
    both = [first, {**first, "estado_ciclo": "Vacía"}]
    fields = "seq long, id_ciclo long, fecha date, resultado string, tipo_evento string, id_veterinario long"
    edit = (1, first["id_ciclo"], first["fecha_inicio"] + 3 * DAY, None, first["tipo_evento"], 1)
    elsewhere = (2, 999, first["fecha_inicio"], "Exitoso", None, 1)
    orders = {"editar_servicio": rows(fields, [edit]), "editar_parto": rows(fields, [elsewhere])}
    found = []
    for names in (["editar_servicio"], [*orders]):
        got = reproducir_ciclos(
            rows(SCHEMA, [tuple(c[k] for k in CYCLE) for c in both]),
            rows("id_alerta long, id_ciclo long, id_animal long, tipo_alerta string, fecha_programada date, estado_alerta string", []),
            rows("id_vaca_detalle long, id_animal long, estado_reproductivo string, es_vigente boolean", []),
            rows("id_colaborador long", [(1,)]),
            {n: orders[n] for n in names},
            TODAY.isoformat(),
        )
        found.append([sorted(map(str, got[n].collect())) for n in ("tbl_auditoria_ciclo", "tbl_ciclo_reproductivo")])
        assert {r.fecha_inicio for r in got["tbl_ciclo_reproductivo"].collect()} == {edit[2]}
    assert found[0] == found[1]
