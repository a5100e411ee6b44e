import random
import re
import zlib
from collections import Counter

import pytest

from hatospark.llm.spelling import near_words, spelling_variants, variants, vocabulary


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(words):
    """{word: (form, root, n, n_near, form_n)}"""
    near = {w: sorted((v for v in words if is_near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: v[0] for w, v in near.items() if v and words[v[0]] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def counted(docs):
    words = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: tuple(r)[1:] for r in got}


def random_words(rng, n, letters, least, most):
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
        words.add(w)
    return {w: int(5 ** rng.uniform(1, 7)) for w in words}


@pytest.mark.parametrize("limit", [4, 20, 512])
@pytest.mark.parametrize("letters, least, most", [("ab", 6, 9), ("abé", 6, 7), ("abcdefgh", 6, 8)])
def test_equals_brute_force(rows, limit, letters, least, most):
    """Dense words, and groups that are split down to a single letter."""
    words = random_words(random.Random(limit), 400, letters, least, most)
    assert found(variants(rows("word string, n long", words.items()), limit=limit)) == brute_force(words)


def test_words_of_any_length(rows):
    rng = random.Random(2)
    base = ["".join(rng.choice("xyz") for _ in range(k)) for k in (6, 7, 63, 64, 65, 300, 40_000)]
    words = {}
    for w in base:
        for _ in range(6):
            i = rng.randrange(len(w))
            for v in (w, w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "q" + w[i + 1 :]):
                if len(v) >= 6:
                    words[v] = rng.randint(5, 900)
    assert found(variants(rows("word string, n long", words.items()))) == brute_force(words)


def test_many_words_around_one_letter(rows):
    """One large group that no split makes smaller, ties, and a chain of forms."""
    words = {f"prefix{chr(c)}suffix": 7 for c in [*range(97, 123), *range(224, 256)]}
    words |= {"prefixsuffix": 50, "prefixsufix": 10, "prefixsufixx": 2, "abcdef": 9, "zzzzzz": 9}
    got = found(variants(rows("word string, n long", words.items()), limit=5))
    assert got == brute_force(words)
    assert got["prefixsufixx"][:2] == ("prefixsufix", "prefixsuffix")


def test_documents(odd_documents, no_documents, rows):
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    rng = random.Random(4)
    names = ["running", "RUNNING", "Élément", "élément", "naïveté", "letters", "shorts", "×÷×÷×÷", "abc-def"]
    docs += [(i, " ".join(rng.choice(names) for _ in range(300))) for i in range(40)]
    docs.append((99, "lettrs runing Lettersx " * 6))
    want = counted(docs)
    df = rows("doc_id long, text string", docs)
    assert {r.word: r.n for r in vocabulary(df.repartition(3)).collect()} == want
    assert found(spelling_variants(df)) == brute_force(want)
    assert any(v[0] for v in brute_force(want).values())
    assert set(found(spelling_variants(odd_documents))) == set(counted([(r.doc_id, r.text) for r in odd_documents.collect()]))
    assert spelling_variants(no_documents).collect() == []
    assert near_words(rows("word string, n long", [])).collect() == []
