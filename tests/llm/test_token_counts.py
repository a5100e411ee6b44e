import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hatospark.llm.token_counts import Budget, PrefixCounter, prefix_counts, token_counts, truncated

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PATH)


def n_of(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_equals_the_library(library, counter):
    rng = random.Random(1)
    letters = "aabcdehilmnorstuv' '  \n\t!.,#0123éßñ日本ÀΩ ՘😀'llre'sdt\xa0　"
    for _ in range(700):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        text += rng.choice(["", "", "", "<|endoftext|>" + text[:5], "<|endof"])
        assert counter.count(text) == n_of(library, text)
        assert counter.prefixes(text) == [n_of(library, text[:i]) for i in range(len(text) + 1)]


def test_classes_of_all_code_points(library, counter):
    for start in range(0, 0x110000, 64):
        points = [c for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)} b" for c in points)
        if text and start % 1024 == 0 or start < 0x3000:
            assert counter.count(text) == n_of(library, text), hex(start)


def test_long_runs(library, counter):
    for text in ("a" * 50_000, " " * 5000, "\n" * 3000 + "x", "!?" * 4000, "Zß" * 9000):
        assert counter.count(text) == n_of(library, text)


def test_budget(library, counter):
    text = "The quick brown fox doesn't jump over 12345 lazy dogs. " * 3
    budget = Budget(counter.prefixes(text))
    for tokens in range(0, 60, 7):
        n = budget.longest(tokens)
        assert n_of(library, text[:n]) <= tokens
        assert all(n_of(library, text[:i]) > tokens for i in range(n + 1, len(text) + 1))


def test_rows(odd_documents, no_documents, library):
    out = token_counts(odd_documents, PATH).collect()
    assert len(out) == odd_documents.count()
    texts = [r.text or "" for r in odd_documents.collect()]
    assert [r.n_bytes for r in out] == [len(t.encode()) for t in texts]
    assert [r.n_tokens for r in out] == [n_of(library, t) for t in texts]
    assert [r.over_limit for r in out] == [r.n_tokens > 1024 for r in out]
    assert token_counts(no_documents, PATH).count() == 0


def test_frames_of_prefixes(rows, library):
    docs = rows("doc_id long, text string", [(1, "It's one  two"), (2, None)])
    got = {r.doc_id: r.counts for r in prefix_counts(docs, PATH).collect()}
    assert got[2] == [0] and got[1][-1] == n_of(library, "It's one  two")
    cut = {r.doc_id: (r.text, r.n_tokens) for r in truncated(docs, PATH, 2).collect()}
    assert cut == {1: ("It's", 2), 2: ("", 0)}
