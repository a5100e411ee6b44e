import random
import re

from hatospark.llm.mixing import WEIGHTS, mix, mixed
from tests.llm.conftest import DOCUMENTS


def brute_targets(sizes):
    """Deals and deals again until no source is over its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_budgets(rows):
    rng = random.Random(3)
    docs = [
        (i, " ".join("x" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), "en",
         rng.choice(["a", "a", "a", "a", "b", "Z", "ä", None, "c", "d", "e"]), 1)
        for i in range(3000)
    ]
    out = mixed(rows(DOCUMENTS, docs)).collect()
    assert len(out) == 3000
    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1])) for d in docs}
    sums = {}
    for d in docs:
        sums[d[3]] = sums.get(d[3], 0) + size[d[0]]
    want = brute_targets(sums)
    got = {}
    for r in out:
        assert r["size"] == size[r.doc_id] and r.source_size == sums[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        got[r.source] = got.get(r.source, 0) + r.taken
    for s, n in got.items():
        assert abs(n - want[s]) <= 1
    again = {r.doc_id: r.taken for r in mixed(rows(DOCUMENTS, docs[::-1])).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_odd_documents(odd_documents, no_documents):
    out = mixed(odd_documents).collect()
    assert len(out) == odd_documents.count()
    assert all(r.taken <= 2 * r["size"] for r in out)
    assert mixed(no_documents).count() == 0
    kept = mix(odd_documents)
    assert set(odd_documents.columns) <= set(kept.columns) and kept.count() == len(out)
    assert mix(no_documents).count() == 0
