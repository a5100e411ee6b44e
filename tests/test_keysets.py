"""Bitmaps of keys against sets."""

import random

from hatospark.functions.keysets import key_bitmaps, not_in


def test_equals_sets(rows):
    rng = random.Random(1)
    edge = [0, 1, -1, 32767, 32768, 32769, -32767, -32768, -32769, 65536, 65537, 2**62, -(2**62)]
    keys = [(p, k) for p in (0, 1) for k in [*rng.sample(range(-70000, 70000), 3000), *edge[p::2]]]
    asked = [(p, k) for p in (0, 1, 2) for k in [*rng.sample(range(-70000, 70000), 3000), *edge]]
    have = rows("p int, clave long", [*keys, *keys[:50], (0, None)])
    want = rows("p int, clave long, n int", [(*a, i) for i, a in enumerate(sorted(set(asked)))])
    got = not_in(want, have, ["p"], "clave").collect()
    assert sorted((r.p, r.clave) for r in got) == sorted(set(asked) - set(keys))
    assert got[0].asDict().keys() == {"p", "clave", "n"}


def test_dense_keys_share_a_row(rows, spark):
    keys = spark.range(1, 32769 * 3).selectExpr("0 AS p", "id AS clave")
    assert key_bitmaps(keys, ["p"], "clave").count() == 4  # 98,306 keys
    assert not_in(rows("p int, clave long", [(0, 5), (0, 98307)]), keys, ["p"], "clave").collect() == [(0, 98307)]
