import random
import re

import xxhash

from hatospark.llm import simhash
from hatospark.llm.components import roots
from tests.llm.conftest import DOCUMENTS, words

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(i for i in prints if i is not None)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(2)
    for level in range(3):
        masks = [m & (2**64 - 1) for m in simhash.masks(level)]
        assert len(masks) == 31
        for _ in range(3000):
            apart = sum(1 << i for i in rng.sample(range(64), 4))
            assert any(m & apart == 0 for m in masks)


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == plain_components(prints)
    one = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert one == set(plain_components(prints).values())


def test_full_buckets_lose_no_link(spark):
    """Dense fingerprints in buckets of two: every level of splitting is used."""
    rng = random.Random(4)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for i in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << i
            prints.add(x)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), bucket=12).collect()
    parent = {p: p for (p,) in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert (r.a ^ r.b).bit_count() <= 4 or ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4
        parent[find(r.a)] = find(r.b)
    want = plain_components({p & (2**64 - 1): p & (2**64 - 1) for (p,) in signed})
    groups, plain = {}, {}
    for (p,) in signed:
        groups.setdefault(find(p), set()).add(p & (2**64 - 1))
        plain.setdefault(want[p & (2**64 - 1)], set()).add(p & (2**64 - 1))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_roots_of_long_chains(spark):
    links = spark.range(0, 60).selectExpr("id AS a", "id + 1 AS b").union(
        spark.range(100, 104).selectExpr("id AS a", "100L AS b")
    )
    got = {r.node: r.root for r in roots(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 104)}


def test_odd_documents(odd_documents, no_documents):
    out = simhash.near_duplicates(odd_documents).collect()
    assert len(out) == odd_documents.count()
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by_id[2].component_id == 1 and by_id[1].component_id == 1
    assert {by_id[i].fingerprint for i in (3, 4, 5)} == {"0" * 16}
    assert {by_id[i].component_id for i in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == ["doc_id", *[c for c in odd_documents.columns if c != "doc_id"]]
    assert kept.filter("doc_id IS NULL").count() == 2


def test_one_row_of_each_group_where_ids_repeat(rows):
    rng = random.Random(6)
    a, b = words(rng, 200), words(rng, 200)
    docs = [(1, a, "en", "a", 1), (1, a, "en", "a", 1), (5, a, "en", "a", 1), (5, b, "en", "a", 1), (1, b + " x", "fr", "b", 1)]
    docs += [(7, words(rng, 200), "en", "a", 1), (None, a, "en", "a", 1)]
    near = [r.component_id for r in simhash.near_duplicates(rows(DOCUMENTS, docs)).collect()]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(rows(DOCUMENTS, docs)).collect())
    prints = {plain_fingerprint(b), plain_fingerprint(b + " x")}
    same = bin(min(prints) ^ max(prints)).count("1") <= 4
    assert len(near) == 7
    assert kept == sorted([(0, a), (1, a), (1, b + " x"), (7, docs[5][1])] + ([] if same else [(5, b)]))
