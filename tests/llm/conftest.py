import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = "score double, kept boolean, key long, size long, target double, version long, h long, fp long, t string, _text string, least long, lo long, _id long, _version long, _gone long, _place long, _rest string, _row long, row string, place long, gone boolean, first long, n long, _tie long, item long, seed long"


def words(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, clashing columns."""
    rng = random.Random(1)
    text = words(rng, 200)
    rows = [
        (1, text, "en", "a", 9),
        (1, text, "en", "a", 9),
        (2, text, "en", "a", 9),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \n\t\n ", "en", None, 5),
        (None, text, None, "b", 9),
        (None, None, None, None, None),
        (6, "word " * 60_000, "en", "b", 300_000),
        (7, words(rng, 30_000), "fr", "b", 1),
        (8, "\n".join([words(rng, 30)] * 9), "fr", "b", 1),
        (9, "日本語 " + words(rng, 100), "ja", "b", 1),
        (10, "1 2 3 !!", "en", "c", 8),
    ]
    clash = [c.split() for c in CLASH.split(", ")]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.selectExpr("*", *[f"CAST(NULL AS {kind}) AS {name}" for name, kind in clash])


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (None, 1, 0), (8, None, None), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
