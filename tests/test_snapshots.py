"""A batch rewrites the key ranges it touches and no others."""

import glob
import os
from decimal import Decimal

from hatospark.functions.snapshots import read_snapshot, touched, update_snapshot, write_snapshot
from hatospark.operators import changes as C

ANIMAL = "id_animal long, peso_actual_kg decimal(7,2)"
WEIGHT = "id_pesaje long, id_animal long, peso_kg decimal(7,2)"


def _files(folder):
    return {f: (os.stat(f).st_mtime_ns, os.stat(f).st_ino) for f in glob.glob(f"{folder}/tramo=*/*.parquet")}


def _ranges(files):
    return {int(f.split("tramo=")[1].split("/")[0]) for f in files}


def test_only_touched_ranges_are_rewritten(spark, rows, tmp_path):
    folder = str(tmp_path / "estado")
    animal = rows(ANIMAL, [(i, Decimal(i)) for i in range(-20, 100)])
    write_snapshot(animal, "id_animal", folder, width=10)
    before = _files(folder)
    assert _ranges(before) == set(range(-2, 10)) and len(before) == 12
    batch = rows(WEIGHT, [(1, 5, Decimal(50)), (3, 5, Decimal(70)), (2, 5, Decimal(60)), (4, 97, Decimal(1)),
                          (5, 500, Decimal(2)), (6, -11, Decimal(9)), (7, None, Decimal(8))])
    change = lambda part: C.aplicar_pesajes(part, batch)
    assert touched(batch, "id_animal", 10) == [-2, 0, 9, 50]
    assert update_snapshot(folder, batch, "id_animal", change, animal, 10) == [-2, 0, 9, 50]
    after = _files(folder)
    same = {f for f in after if after[f] == before.get(f)}
    assert _ranges(same) == set(range(-2, 10)) - {-2, 0, 9} and _ranges(set(after) - same) == {-2, 0, 9}
    want = sorted(C.aplicar_pesajes(animal, batch).collect())
    assert sorted(read_snapshot(spark, folder, animal).collect()) == want
    # The same batch again changes no row.
    update_snapshot(folder, batch, "id_animal", change, animal, 10)
    assert sorted(read_snapshot(spark, folder, animal).collect()) == want


def test_new_rows_and_empty_batches(spark, rows, tmp_path):
    folder = str(tmp_path / "estado")
    schema = "id_detalle long, id_animal long, fecha_inicio date, fecha_fin date, es_vigente boolean"
    day = __import__("datetime").date
    old = rows(schema, [(i, i, day(2024, 1, 1), None, True) for i in range(30)])
    write_snapshot(old, "id_animal", folder, width=10)
    before = _files(folder)
    none = rows(schema)
    assert update_snapshot(folder, none, "id_animal", lambda part: part, old, 10) == []
    assert _files(folder) == before
    new = rows(schema, [(30, 3, day(2024, 2, 1), None, True), (31, 45, day(2024, 3, 1), None, True)])
    update_snapshot(folder, new, "id_animal", lambda part: C.scd2(part, new, "id_detalle"), old, 10)
    got = sorted(read_snapshot(spark, folder, old).collect())
    assert got == sorted(C.scd2(old, new, "id_detalle").collect()) and len(got) == 32
    assert _ranges(set(_files(folder)) - set(before)) == {0, 4}


def test_plan_lists_the_touched_partitions_only(spark, rows, tmp_path, capsys):
    folder = str(tmp_path / "estado")
    animal = rows(ANIMAL, [(i, Decimal(i)) for i in range(100)])
    write_snapshot(animal, "id_animal", folder, width=10)
    seen = []
    batch = rows(WEIGHT, [(1, 5, Decimal(50))])

    def change(part):
        part.explain("formatted")
        seen.append(capsys.readouterr().out)
        return C.aplicar_pesajes(part, batch)

    update_snapshot(folder, batch, "id_animal", change, animal, 10)
    assert "PartitionFilters: [isnotnull(tramo" in seen[0] or "tramo" in seen[0].split("PartitionFilters")[1]
