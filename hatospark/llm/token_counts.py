"""Token counts by dynamic programming over prefixes of a byte-level BPE vocabulary.

The encoding of a byte string ends in exactly one token whose removal leaves the encoding of a
shorter prefix.  So one pass over a piece (what the pre-tokenizer cuts out) finds, for each of its
prefixes, the last token and the number of tokens.  Pieces repeat: each task keeps the tables of the
pieces it has seen.  The count of any prefix of a text is then a sum of known numbers, and
truncation and budget questions need no second encoding.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate
import json

import ahocorasick
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .texts import map_texts

#: Fixed value: the cutting pattern of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on whose class the two Unicode tables in use can differ; such texts are cut by the library.
UNSURE = (
    "[՘֋֌࢏౜೜₏-₟꟎-ꟿ꭬-꭭\U00010000-\U0010ffff]"
)
#: Entries that a Python worker keeps of what it has computed; beyond, it starts anew.
KNOWN_PIECES, KNOWN_PAIRS = 600_000, 200_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self._set_up(f.read())

    def _set_up(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.rank = {}
        for place, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[raw(left), raw(right)] = place
        tokens = [raw(t) for t in spec["model"]["vocab"]]
        self.ends = ahocorasick.Automaton()
        for t in tokens:
            self.ends.add_word(t.decode("latin-1"), t)
        self.ends.make_automaton()
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials)) or r"(?!)")
        self.has_special = [s for s in specials if s]
        self.pieces = regex.compile(PIECES)
        self.unsure = regex.compile(UNSURE)
        self.cutter = Tokenizer.from_str(vocabulary).pre_tokenizer
        self.fits = lru_cache(maxsize=KNOWN_PAIRS)(self._fits)
        self.table = lru_cache(maxsize=50_000)(self._table)
        self.totals: dict[str, int] = {}

    def _merged(self, data: bytes) -> list[bytes]:
        """Merges in rank order, for the short strings that decide whether two tokens are neighbours."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: bytes, right: bytes) -> bool:
        return self._merged(left + right) == ([left, right] if left else [right])

    def _table(self, piece: str) -> list[int]:
        """Token counts of the first 0, 1, ... bytes of a piece."""
        data = piece.encode("utf-8")
        count, last = [0] * (len(data) + 1), [b""] * (len(data) + 1)
        for end, token in self.ends.iter(data.decode("latin-1")):
            end += 1
            if last[end]:
                continue
            start = end - len(token)
            if (last[start] or not start) and self.fits(last[start], token):
                count[end], last[end] = count[start] + 1, token
        return count

    def _piece_total(self, piece: str) -> int:
        if len(piece) > 64:
            return self._table(piece)[-1]
        if len(self.totals) >= KNOWN_PIECES:
            self.totals.clear()
        n = self.totals[piece] = self._table(piece)[-1]
        return n

    def _parts(self, text: str) -> list[str]:
        if self.unsure.search(text):
            return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]
        return self.pieces.findall(text)

    def _total(self, text: str) -> int:
        parts = self._parts(text)
        counts = list(map(self.totals.get, parts))
        if None in counts:
            counts = [self._piece_total(p) if c is None else c for p, c in zip(parts, counts)]
        return sum(counts)

    def count(self, text: str) -> int:
        """Tokens of the whole text; a special string counts as one token."""
        if not any(s in text for s in self.has_special):
            return self._total(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._total, parts))

    def prefixes(self, text: str) -> list[int]:
        """Token counts of the first 0, 1, ... code points, each as if the text ended there."""
        out, base, at = [0], 0, 0
        for m in [*self.special.finditer(text), None]:
            plain = text[at : m.start() if m else len(text)]
            out += [base + n for n in self._plain_prefixes(plain)[1:]]
            base += self._total(plain)
            if not m:
                return out
            # Before its end, the special string is ordinary text after the plain one.
            for k in range(1, len(m[0])):
                out.append(base - self._total(plain) + self._total(plain + m[0][:k]))
            base += 1
            out.append(base)
            at = m.end()

    def _plain_prefixes(self, text: str) -> list[int]:
        out, before, run, run_before = [0], 0, "", 0
        for piece in self._parts(text):
            table, at = self.table(piece), 0
            for i, c in enumerate(piece):
                at += len(c.encode("utf-8"))
                if c.isspace() and self._blank(c):
                    # The white space that ends a text is one piece.
                    run_before = run_before if run else before + (table[at - 1] if i else 0)
                    run += c
                    out.append(run_before + self.table(run)[-1])
                    continue
                run = ""
                if piece[0] == "'" and 0 < i < len(piece) - 1 and self.pieces.fullmatch(piece[1:]):
                    out.append(before + sum(self.table(p)[-1] for p in self._parts(piece[: i + 1])))
                else:
                    out.append(before + table[at])
            before += table[-1]
        return out

    def _blank(self, c: str) -> bool:
        return regex.fullmatch(r"\s", c) is not None


class Budget:
    """Answers about one text from its stored prefix counts."""

    def __init__(self, counts: list[int]):
        self.counts = counts
        #: The least count of this or any longer prefix: rises, so it can be searched.
        self.least = list(accumulate(reversed(counts), min))[::-1]

    def longest(self, tokens: int) -> int:
        """Code points of the longest prefix of at most ``tokens`` tokens."""
        return bisect_right(self.least, tokens) - 1


@lru_cache(maxsize=1)
def _counter(name: str) -> PrefixCounter:
    """One counter for all tasks of a Python worker, from the executor's copy of the file."""
    return PrefixCounter(SparkFiles.get(name))


def _shipped(docs: DataFrame, path: str) -> str:
    """Send the vocabulary file to the executors; its name there."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def token_counts(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its id, UTF-8 bytes, tokens, and whether these are over ``limit``.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows and null ids come back as they are;
    other columns are not read. ``path`` names a byte-level BPE file of the ``tokenizers`` library.
    """
    name = _shipped(docs, path)

    def make():
        counter = _counter(name)

        def one(value):
            value = value or ""
            n = counter.count(value)
            return len(value.encode("utf-8")), n, n > limit

        return one

    return map_texts(
        docs, [F.col(id_col)], text, make, "n_bytes bigint, n_tokens bigint, over_limit boolean"
    )


def prefix_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row ``counts``: entry i is the token count of the first i code points (null text: [0])."""
    name = _shipped(docs, path)

    def make():
        counter = _counter(name)
        return lambda value: (counter.prefixes(value or ""),)

    return map_texts(docs, [F.col(id_col)], text, make, "counts array<int>")


def truncated(
    docs: DataFrame, path: str, tokens: int, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row the longest prefix of its text that has at most ``tokens`` tokens, and their number."""
    name = _shipped(docs, path)

    def make():
        counter = _counter(name)

        def one(value):
            counts = counter.prefixes(value or "")
            n = max(0, Budget(counts).longest(tokens))
            return (value or "")[:n], counts[n]

        return one

    return map_texts(docs, [F.col(id_col)], text, make, "text string, n_tokens bigint")
