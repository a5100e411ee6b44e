import random

from pyspark.sql import functions as F

from hatospark.llm import quality_rules as Q
from tests.llm.conftest import DOCUMENTS, words


def plain_counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines)


def test_counts_against_plain_ones():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c ", "\n", "\t", "#", "é", "\xa0", "\x1f", "日"]) for _ in range(rng.randrange(0, 60)))
        assert Q.text_counts(text) == plain_counts(text)


def test_sketch_quantiles(rows):
    """A fence from the sketch is within one bin of the fence from the exact quartiles."""
    rng = random.Random(2)
    docs = [(i, words(rng, 60) + " #" * rng.randrange(0, 40), "en", "a", 1) for i in range(400)]
    measured = Q.measured(rows(DOCUMENTS, docs), [F.col("doc_id"), F.col("lang")])
    found = Q.fences(Q.sketches(measured, ["lang"]), ["lang"]).first()
    fence = found.fences["symbol_share"].high
    values = sorted(r.n_symbols / r.n_words for r in measured.collect())
    low, high = values[99], values[299]
    assert found.n == 400 and abs(fence - (high + 3 * (high - low + 0.01))) < 0.05 * fence
    assert abs(found.fences["symbol_share"].low - (low - 3 * (high - low + 0.01))) < 0.05 * fence


def test_small_groups_are_judged_by_all(rows):
    """A group under 20 documents has the fences of the merged sketches, and a null one is a group."""
    rng = random.Random(4)
    docs = [(i, words(rng, 100), "en", "a", 1) for i in range(200)]
    docs += [(200 + i, words(rng, 100) + " #x" * 30, "en", "b", 1) for i in range(19)]
    docs += [(300 + i, words(rng, 100) + " #x" * 30, None, None, 1) for i in range(20)]
    kept = {r.doc_id for r in Q.quality_rules(rows(DOCUMENTS, docs)).filter("kept").collect()}
    assert kept == {*range(200), *range(300, 320)}


def test_each_group_has_its_own_fences(spark):
    """The sketches decide: fences of word length differ between all groups of sf0.1, on both sides."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = Q.measured(docs, [F.col("lang"), F.col("source")]).filter("NOT base_failed")
    found = Q.fences(Q.sketches(rows, ["lang", "source"]), ["lang", "source"]).collect()
    length = [r.fences["word_length"] for r in found]
    assert len(found) == 80 and max(f.high for f in length) < 7.5 and min(f.low for f in length) > 3
    assert len({round(f.high, 1) for f in length}) > 4
    assert len({round(r.fences["repeat_share"].high, 3) for r in found}) > 2


def test_outliers_of_their_own_group(rows):
    rng = random.Random(3)
    docs = [(i, words(rng, 100), "en", "plain", 1) for i in range(200)]
    docs += [(1000 + i, words(rng, 100) + " #x" * rng.randrange(30, 40), "en", "code", 1) for i in range(200)]
    docs += [(5000, words(rng, 100) + " #x" * 35, "en", "plain", 1), (5001, "short", "en", "code", 1)]
    out = {r.doc_id: r for r in Q.quality_rules(rows(DOCUMENTS, docs)).collect()}
    assert all(out[i].kept for i in range(200)) and all(out[1000 + i].kept for i in range(200))
    assert not out[5000].kept and not out[5000].base_failed
    assert out[5001].base_failed and not out[5001].kept


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.quality_rules(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.01


def test_odd_documents(odd_documents, no_documents):
    out = Q.quality_rules(odd_documents).collect()
    assert len(out) == odd_documents.count()
    texts = sorted((r.text or "") for r in odd_documents.collect() if len(r.text or "") < 5000)
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in out if r.n_words < 1000)
    assert got == sorted(map(plain_counts, texts))
    assert all(not r.kept for r in out if r.base_failed) and all(r.kept is not None for r in out)
    assert Q.quality_rules(no_documents).count() == 0
