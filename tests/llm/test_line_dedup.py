import random

import pytest

import corpus_pipeline

from hatospark.llm import line_dedup as L
from tests.llm.conftest import DOCUMENTS


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        at, how = rng.randrange(len(text) + 1), rng.random()
        if how < 0.3 and at < len(text):
            text[at] = rng.choice("abcé")
        elif how < 0.6 and at < len(text):
            del text[at]
        else:
            text.insert(at, rng.choice("abcé"))
    return "".join(text)


def test_edit_distance(rows):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        pairs.append((a, changed(rng, a, rng.randrange(0, 6))))
    for t in (1, 2, 3):
        got = sorted((r.x, r.y) for r in L.verified(rows("x string, y string", pairs), "x", "y", t).collect())
        assert got == sorted(p for p in pairs if edits(*p) <= t)


@pytest.mark.parametrize("full", [64, 2])
def test_links_against_all_pairs(spark, rows, monkeypatch, full):
    """Also with keys that count as full from three lines on, so that rests are joined."""
    monkeypatch.setattr(L, "FULL_KEY", full)
    rng = random.Random(4)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randrange(5, 16))).strip() or "a" for _ in range(15)]
    lines = sorted({changed(rng, b, rng.randrange(0, 4)) for b in base for _ in range(8)} - {""})
    df = rows("line string", [(x,) for x in lines])
    df = df.selectExpr("xxhash64(line) AS h", "length(line) AS n", "line").cache()
    named = {(r.h, r.n): r.line for r in df.collect()}
    for t in (1, 2) if full == 64 else (1,):
        got = {
            tuple(sorted((named[tuple(r.a)], named[tuple(r.b)])))
            for r in L.line_links(df, t, 0).collect()
        }
        want = {
            tuple(sorted((a, b)))
            for i, a in enumerate(lines)
            for b in lines[:i]
            if edits(a, b) <= t and min(len(a), len(b)) > t
        }
        assert got == want


def test_classes_and_texts(rows):
    line, near, short = "a line of some length, long enough", "a line of some length, lang enough", "short"
    docs = [(i, f"own text number {i} of this document, with words of its own {i * 7}\n{near if i % 2 else line}\n{short}", "en", "a", None) for i in range(10)]
    docs.append((50, f"{line}\n  {line} \n\n", "en", "a", 1))
    df = rows(DOCUMENTS, docs)
    got = {(r.doc_id, r.line_no): r for r in L.line_classes(df).collect()}
    assert got[7, 1].first_doc_id == 0 and got[7, 1].first_line_no == 1 and got[7, 1].times == 12
    assert [got[i, 1].kept for i in range(3)] == [True, False, False]
    assert got[3, 2].times == 10 and got[0, 0].times == 1 and (50, 2) not in got
    out = {r.doc_id: r.text for r in L.without_repeated_lines(df).collect()}
    assert out[0] == docs[0][1] and out[4] == docs[4][1].split("\n")[0] and 50 not in out


def test_whole_table_of_equal_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = L.line_classes(docs).collect()
    places = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        for k, line in enumerate(r.text.split("\n")):
            if line.strip():
                places.setdefault(line.strip(), []).append((r.doc_id, k))
    assert len(got) == sum(map(len, places.values()))
    first = {p: v[0] for v in places.values() for p in v}
    for r in got:
        assert (r.first_doc_id, r.first_line_no) <= first[r.doc_id, r.line_no]
        assert r.kept == (r.times <= 6 or (r.first_doc_id, r.first_line_no) == (r.doc_id, r.line_no))


def test_odd_documents(odd_documents, no_documents):
    assert {r.doc_id for r in L.line_classes(odd_documents).collect()} == {1, 2, 6, 7, 8, 9, 10}
    assert L.line_classes(no_documents).count() == 0
    out = L.without_repeated_lines(odd_documents)
    assert out.schema.names == odd_documents.schema.names
    ids = sorted(r.doc_id for r in out.filter("doc_id IS NOT NULL").collect())
    assert ids == [1, 1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert out.filter("doc_id IS NULL").count() == 2


def test_pipeline_leaves_one_of_each_long_line(rows):
    line, short = "a line of some length that stands in two documents", "short"
    docs = [(i, f"{chr(97 + i) * 40}\n{line}\n{short}", "en", "a", None) for i in range(2)]
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(None, rows(DOCUMENTS, docs), None).collect()}
    assert out == {0: docs[0][1], 1: f"{'b' * 40}\n{short}"}


def test_pipeline_leaves_what_stands_nowhere_else(rows):
    line, own = "a line that many documents share " * 20, "own text of this document and of no other one"
    docs = [(i, line, "en", "a", None) for i in range(8)] + [(9, f"{line}\n\n{own}", "en", "a", None)]
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(None, rows(DOCUMENTS, docs), None).collect()}
    assert out == {0: line, 9: f"\n{own}"}
