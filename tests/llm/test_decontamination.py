import itertools
import random
import re

from hatospark.llm import decontamination as D
from tests.llm.conftest import DOCUMENTS, words

ITEM = "item_id long, text string"


def test_masks_hit_every_window():
    for gone in itertools.combinations(range(D.WINDOW), D.ALLOWED):
        assert any(
            not any(start + o in gone for o in mask)
            for mask in D.MASKS
            for start in range(D.WINDOW - D.SPAN + 1)
        )


def test_substitutions(rows):
    rng = random.Random(6)
    items = [(i, words(rng, 40)) for i in range(5)] + [(5, words(rng, 9)), (6, words(rng, 5))]
    docs, want = [], set()
    for k in range(60):
        own = words(rng, 80).split()
        i = k % 7
        part = items[i][1].upper().split()
        if i < 5:
            begin, n = rng.randrange(0, 20), rng.choice([12, 13, 20])
            part = part[begin : begin + n]
        n_changed = k % 4
        for at in rng.sample(range(min(13, len(part))), min(n_changed, len(part))):
            part[at] = "x"
        own[30:30] = part
        docs.append((k, ", ".join(own), "en", "a", 1))
        plain = [re.findall(r"\w+", t.lower()) for t in (docs[-1][1], items[i][1])]
        if contaminated(*plain):
            want.add((k, i))
    got = {(r.doc_id, r.item_id) for r in D.leaks(rows(DOCUMENTS, docs), rows(ITEM, items)).collect()}
    assert got == want and len(want) > 20
    clean = {r.doc_id for r in D.without_leaks(rows(DOCUMENTS, docs), rows(ITEM, items)).collect()}
    assert clean == set(range(60)) - {k for k, _ in want}


def contaminated(doc, item):
    if len(item) < D.SPAN:
        return False
    w = min(D.WINDOW, len(item))
    need = w - (D.ALLOWED if len(item) >= D.WINDOW else 0)
    return any(
        sum(a == b for a, b in zip(doc[i : i + w], item[j : j + w])) >= need
        for i in range(len(doc) - w + 1)
        for j in range(len(item) - w + 1)
    )


def test_whole_table_against_all_windows(spark):
    """Documents that hold a run of 13 item tokens are found; what is found agrees as it has to."""
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = {}
    plain_items = {r.item_id: tokens(r.text) for r in items.collect()}
    for i, w in plain_items.items():
        for k in range(len(w) - 12):
            runs.setdefault(tuple(w[k : k + 13]), set()).add(i)
    plain = {r.doc_id: tokens(r.text) for r in docs.collect()}
    want = {
        (d, i) for d, w in plain.items() for k in range(len(w) - 12) for i in runs.get(tuple(w[k : k + 13]), ())
    }
    found = D.leaks(docs, items).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in found}
    for r in found:
        a = plain[r.doc_id][r.doc_start : r.doc_start + r.n_tokens]
        b = plain_items[r.item_id][r.item_start : r.item_start + r.n_tokens]
        assert r.n_equal == sum(x == y for x, y in zip(a, b)) >= 11


def test_odd_rows(odd_documents, no_documents, rows):
    text = odd_documents.filter("doc_id = 2").first().text
    items = [(1, " ".join(text.split()[20:40])), (2, None), (3, ""), (None, "word " * 30), (4, "a b")]
    bench = rows(ITEM, items)
    got = {(r.doc_id, r.item_id) for r in D.leaks(odd_documents, bench).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (6, None)}
    assert D.leaks(no_documents, bench).count() == 0
    assert D.leaks(odd_documents, bench.limit(0)).count() == 0
    assert D.without_leaks(no_documents, bench).count() == 0
    kept = D.without_leaks(odd_documents, bench)
    assert kept.columns == odd_documents.columns
    assert kept.count() == odd_documents.count() - 5
