"""Ordered and skew-safe building blocks against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from hatospark.functions.checkpoints import shared_folder
from hatospark.functions.components import least_of_component
from hatospark.functions.ids import assign_ids
from hatospark.functions.joins import left_join_many
from hatospark.functions.outputs import write_outputs
from hatospark.functions.sequence import next_value, previous_value, total_before


def _data(seed):
    rng = random.Random(seed)
    seqs = rng.sample(range(200), 80)
    # Key 1 holds half of the rows.
    return [(1 if rng.random() < 0.5 else rng.randint(2, 6), s, rng.choice([None, rng.randint(0, 9)])) for s in seqs]


def test_neighbours_and_totals_match_brute_force_across_blocks(rows):
    for seed in range(2):
        data = _data(seed)
        df = rows("k long, s long, v int", data)
        df = next_value(df, ["k"], "s", F.col("v"), "nxt", bits=3)
        df = previous_value(df, ["k"], "s", F.col("v"), "prv", bits=3)
        df = total_before(df, "s", F.col("v"), "tot", keys=("k",), bits=3)
        df = total_before(df, "s", F.lit(1), "place", bits=3)
        for r in df.collect():
            later = [(s, v) for k, s, v in data if k == r.k and s > r.s and v is not None]
            earlier = [(s, v) for k, s, v in data if k == r.k and s < r.s and v is not None]
            assert r.nxt == (min(later)[1] if later else None)
            assert r.prv == (max(earlier)[1] if earlier else None)
            assert r.tot == sum(v for _, v in earlier)
            assert r.place == sum(s < r.s for _, s, _ in data)


def test_ids_go_on_after_the_highest_key(rows):
    new = rows("seq long", [(30,), (10,), (20,)])
    got = assign_ids(new, "seq", "id", rows("id long", [(7,), (3,)]), "id").collect()
    assert sorted((r.seq, r.id) for r in got) == [(10, 8), (20, 9), (30, 10)]
    got = assign_ids(new, "seq", "id", rows("id long"), "id").collect()
    assert sorted(r.id for r in got) == [1, 2, 3]


def test_left_join_many_spreads_hot_keys_without_losing_or_adding_rows(rows):
    left = rows("k long, a string", [(1, "x"), (2, "y"), (3, "z")])
    right = rows("k long, r long", [(1, i) for i in range(50)] + [(2, 100), (9, 101)])
    got = left_join_many(left, right, "k", "r", slot_rows=7).select("k", "a", "r").collect()
    want = [(1, "x", i) for i in range(50)] + [(2, "y", 100), (3, "z", None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_places_of_sparse_sequence_numbers(rows):
    rng = random.Random(5)
    seqs = rng.sample(range(2**62), 60) + [0, 1, 2**41, 2**41 + 1, 2**62]
    got = total_before(rows("s long", [(s,) for s in seqs]), "s", F.lit(1), "place")
    assert {r.s: r.place for r in got.collect()} == {s: i for i, s in enumerate(sorted(seqs))}


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_outputs_are_written_once_and_read_back(rows, tmp_path):
    out = write_outputs({"a": rows("x int", [(1,)]), "b": rows("y string")}, str(tmp_path / "job"))
    assert out["a"].collect() == [(1,)] and out["b"].columns == ["y"] and out["b"].count() == 0
    with pytest.raises(Exception, match="already exists"):
        write_outputs({"a": rows("x int", [(2,)])}, str(tmp_path / "job"))


def test_components_against_brute_force(rows):
    """Chains, stars, links to oneself and repeated links."""
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(1000 + i, 1001 + i) for i in range(500)] + [(2000, 2001 + i) for i in range(50)] + [(9000, 9000)]
    root = {n: n for link in links for n in link}
    while True:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    found = least_of_component(rows("a long, b long", links + links[:20])).collect()
    assert len(found) == len(root) and {r.node: r.root for r in found} == root
    assert least_of_component(rows("a long, b long")).count() == 0
