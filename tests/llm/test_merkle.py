import zlib

import pytest

from hatospark.llm.merkle import FIELDS, H, dataset_proofs, folded, manifest, proofs, siblings


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc):
    return H("".join(field(doc[c]) for c in FIELDS))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    out = ""
    for level in tree[:-1]:
        j = i ^ 1
        out += "." if j >= len(level) else ("<" if j < i else ">") + level[j]
        i //= 2
    return out


def brute_force(docs):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    trees = {}
    for d in docs:
        trees.setdefault(d["lang"], []).append(d)
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    out, built = [], {}
    for name in names:
        trees[name].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
        built[name] = levels([leaf(d) for d in trees[name]])
    top = levels([built[n][-1][0] for n in names])
    for g, name in enumerate(names):
        for i, d in enumerate(trees[name]):
            way = path(built[name], i) + path(top, g)
            seen = dict(d)
            if d["doc_id"] is not None and d["n_chars"] is not None:
                seen["n_chars"] += zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
            got = folded(leaf(seen), way)
            out.append((d["doc_id"], leaf(d), built[name][-1][0], top[-1][0], H(siblings(way)), got, got == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_odd_documents(odd_documents, no_documents):
    out = manifest(odd_documents)
    assert out.columns == COLUMNS
    assert rows_of(out) == brute_force([r.asDict() for r in odd_documents.collect()])
    assert manifest(no_documents).collect() == []


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1500])
def test_trees_of_all_shapes(rows, n):
    data = [(i * 3, f"t{i}", [None, "a", "b", "ä"][i % 7 % 4], "s", i) for i in range(n)]
    docs = rows("doc_id long, text string, lang string, source string, n_chars long", data)
    want = brute_force([r.asDict() for r in docs.collect()])
    assert rows_of(manifest(docs.repartition(5))) == want
    assert sum(not r[-1] for r in want) == sum(zlib.crc32(str(i * 3).encode()) % 7 == 0 for i in range(n))


def test_many_rounds(rows):
    """Blocks of two nodes: every level is a round of its own."""
    data = [("1" + "ab"[i > 30], H(str(i)), (i, None)) for i in range(37)]
    leaves = rows("tree string, digest string, item struct<id: long, claim: string>", data)
    few, many = ({r.item.id: (r.path, r.root) for r in proofs(leaves, b).collect()} for b in (8, 1))
    assert few == many and len(few) == 37
    assert all(folded(H(str(i)), p) == root for i, (p, root) in few.items())


def test_paths_come_back(odd_documents):
    for r in dataset_proofs(odd_documents).collect():
        assert folded(r.leaf, r.path) == r.root


def test_numbers_at_their_limit(rows):
    data = [(7 * i, "t", "en", "s", 2**63 - 1) for i in range(8)]
    docs = rows("doc_id long, text string, lang string, source string, n_chars long", data)
    assert rows_of(manifest(docs)) == brute_force([r.asDict() for r in docs.collect()])
