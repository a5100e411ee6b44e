"""Language identification and the quality classifier: held-out accuracy, gradients, odd rows."""

import math

import numpy as np

from hatospark.llm import language_id, quality_classifier
from hatospark.llm.texts import held_out

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.languages(docs)
    both = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in both if r.held_out]
    assert len(both) == docs.count() and 100 < len(held) < 300
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in both)


def test_gradients():
    rng = np.random.default_rng(0)
    p = {
        "table": rng.standard_normal((2, 256, 9)), "inner": rng.standard_normal((2, 3, 9)),
        "outer": rng.standard_normal((2, 3, 3)), "bias": rng.standard_normal(3),
    }
    x, y = rng.integers(0, 256, (5, 4)).astype(np.uint8), rng.integers(0, 3, 4)

    def loss():
        model = language_id.Model(("a", "b", "c"), *[p[k].astype(np.float32) for k in p])
        found = model.probabilities(np.ascontiguousarray(x.T))
        return -np.mean([math.log(found[k, t, b]) for t in range(5) for b, k in enumerate(y)])

    slopes = language_id._slopes({k: v.astype(np.float32) for k, v in p.items()}, x, y)
    for name in p:
        for _ in range(10):
            at = tuple(int(rng.integers(0, d)) for d in p[name].shape)
            if name == "table":
                at = (at[0], int(x[rng.integers(0, 5), rng.integers(0, 4)]), at[2])
            p[name][at] += 1e-2
            up = loss()
            p[name][at] -= 2e-2
            down = loss()
            p[name][at] += 1e-2
            assert abs((up - down) / 2e-2 - slopes[name][at]) < 2e-3


def test_languages_of_odd_documents(odd_documents, no_documents):
    out = language_id.languages(odd_documents).collect()
    assert len(out) == odd_documents.count()
    for r, d in zip(out, odd_documents.collect()):
        letters = any(c.isalpha() for c in d.text or "")
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1
    assert language_id.languages(no_documents).count() == 0


def test_held_out_reads_the_id_as_text(rows):
    import zlib

    ids = [0, 7, 12345, 99999999999]
    got = rows("doc_id long", [(i,) for i in ids]).select(held_out("doc_id")).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality_classifier.quality_scores(docs, labels)
    held = out.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    good = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.98


def test_quality_of_odd_documents(odd_documents, no_documents, labels):
    out = quality_classifier.quality_scores(odd_documents, labels).collect()
    assert len(out) == odd_documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality_classifier.quality_scores(no_documents, labels).count() == 0
    assert quality_classifier.quality_scores(odd_documents, labels.limit(0)).count() == len(out)
    kept = quality_classifier.keep_good(odd_documents, labels)
    assert kept.schema == odd_documents.schema
