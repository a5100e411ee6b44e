"""Spelling variants by a bit-sliced position index.

A pack of words is sliced by position: for each letter that occurs at a position, a bitset tells the
words that have it there.  A query reads its letters from left to right and keeps four bitsets of
the pack: the words that agree so far (no error), and those with one error, by kind - a replaced
letter, a letter that only the query has, a letter that only the word has.  Each step is an AND with
the slice of the same position, or of the one before or after it, for all words of the pack and all
queries at once.

Words meet in a pack only where they can be near.  Of two words of which the shorter has ``s`` letters,
one edit leaves the first ``s // 2`` letters or the others alone, so the words are grouped by both
halves, for ``s`` and ``s - 1``.  A group beyond LIMIT words is split again in the same way by the
letters still unknown, down to one letter.  Of two words that meet in several groups, only the
first one counts them: a group of equal ends leaves out those whose beginnings put them together before.
No pairs are written: a query leaves a count and its best word for each group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint

#: Words of at least so many letters and occurrences; a form occurs ``RATIO`` times as often.
LEAST_LETTERS, LEAST_TIMES, RATIO = 6, 5, 5
#: Of the occurrences of a word in a document, one in so many (by hash) loses a letter.
TYPO_ONE_IN = 199
#: Words of a group, and of a pack of groups; letters of a pack.
LIMIT, PACK, PACK_LETTERS = 512, 1024, 1 << 20
#: Distinct words that a task counts before it hands them on.
KNOWN_WORDS = 200_000

RUN = "[a-zÀ-ÿ]{%d,}"
KEY = ["s", "pre", "suf", "left", "right"]


def _counted(least: int, one_in: int | None):
    """Counts of words, summed up per task before they are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts = re.compile(RUN % least), Counter()

        def rows():
            words = list(counts)
            out = [pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Lower case of bytes: A-Z only.
                lower = (text.as_py() or "").encode().lower().decode()
                found = Counter(runs.findall(lower))
                if one_in and doc_id is not None:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for word in [w for w in found if zlib.crc32(w.encode(), start) % one_in == 0]:
                        at = zlib.crc32(word.encode(), start) % len(word)
                        times, short = found.pop(word), word[:at] + word[at + 1 :]
                        if len(short) >= least:
                            counts[short] += times
                counts.update(found)
                if len(counts) >= KNOWN_WORDS:
                    yield rows()
        if counts:
            yield rows()

    return run


def vocabulary(
    docs: DataFrame,
    least_letters: int = LEAST_LETTERS,
    least_times: int = LEAST_TIMES,
    typo_one_in: int | None = TYPO_ONE_IN,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all texts that are long and frequent enough.

    A run loses a letter where ``typo_one_in`` divides the hash of its document and itself (never in a
    document without an id). Null texts have no words; repeated rows count each time.
    """
    rows = docs.select(F.col(id_col).cast("string"), F.col(text))
    counts = rows.mapInArrow(_counted(least_letters, typo_one_in), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


def _split(rows: DataFrame) -> DataFrame:
    """Each row in the two halves of its group: more letters known on the left, or on the right.

    The group on the right skips pairs that agree in the first ``skip`` letters: those meet on the left.
    """
    half = F.floor((F.col("s") - F.col("pre") - F.col("suf")) / 2).cast("int")
    side = lambda pre, suf, skip: F.struct(pre.alias("pre"), suf.alias("suf"), skip.alias("skip"))
    pre = F.col("pre") + half
    left = side(pre, F.col("suf"), F.col("skip"))
    right = side(F.col("pre"), F.col("s") - pre, pre)
    rows = rows.select("word", "n", "s", F.explode(F.array(left, right)).alias("_k"))
    rows = rows.select("word", "n", "s", "_k.*")
    return rows.withColumns({
        "left": F.substring("word", F.lit(1), F.col("pre")),
        "right": F.expr("right(word, suf)"),
    })


def groups(words: DataFrame, limit: int = LIMIT, letters: int = PACK_LETTERS) -> DataFrame:
    """(word, n, key columns, skip): every pair of near words shares one group that does not skip it."""
    m = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(m, m - 1)).alias("s")).filter("s > 1")
    nothing = {c: F.lit(0) for c in ("pre", "suf", "skip")}
    rows, found = _split(rows.withColumns(nothing)), None
    while True:
        rows = checkpoint(rows)
        sizes = rows.groupBy(*KEY).agg(
            F.count("*").alias("_size"), F.sum(F.char_length("word")).alias("_letters"),
            F.min(F.col("s") - F.col("pre") - F.col("suf")).alias("_free"),
            F.min(F.char_length("word")).alias("_least"),
        ).filter("_size > 1 AND _least = s")
        sizes = sizes.withColumn("_large", F.expr(f"_free > 1 AND (_size > {limit} OR _letters > {letters})"))
        sizes = checkpoint(sizes.select(*KEY, "_large"))
        small = rows.join(sizes.filter("NOT _large").drop("_large"), KEY)
        found = small if found is None else found.unionByName(small)
        large = sizes.filter("_large").drop("_large")
        if large.isEmpty():
            return found
        rows = _split(rows.join(large, KEY))


class Pack:
    """The index of a pack: words in order of preference (most frequent first), sliced by position."""

    def __init__(self, words: list[str], group: np.ndarray):
        self.lengths = np.array([len(w) for w in words])
        self.width = -(-len(words) // 64) * 8
        codes = np.zeros((len(words), self.lengths.max() + 2), np.int32)
        for i, w in enumerate(words):
            codes[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), "<i4")
        letters, self.codes = np.unique(codes, return_inverse=True)
        self.codes = self.codes.reshape(codes.shape)
        self.ends = int(letters[0] == 0)  # code 0 is the end of a word; no letter matches it
        self.n_letters = len(letters)
        self.group = self._bitsets(group, group.max() + 1)

    def _bitsets(self, values: np.ndarray, n: int) -> np.ndarray:
        """A bitset for each of the values 0 to n - 1: the words that have it."""
        bits = np.zeros((n, self.width * 8), np.uint8)
        bits[values, np.arange(len(values))] = 1
        return np.packbits(bits, axis=1).view(np.uint64)

    def _slice(self, position: int) -> np.ndarray:
        """The bitsets of the letters at ``position``; none for what lies outside a word."""
        if position < 0 or position >= self.codes.shape[1]:
            return np.zeros((self.n_letters, self.width // 8), np.uint64)
        out = self._bitsets(self.codes[:, position], self.n_letters)
        if self.ends:
            out[0] = 0
        return out

    def near(self, group: np.ndarray, skip: np.ndarray, s: np.ndarray) -> np.ndarray:
        """For each word of the pack, as a query, the bits of its near words within its group."""
        exact = self.group[group]
        replaced, extra, missing, skipped = (np.zeros_like(exact) for _ in range(4))
        result = np.zeros_like(exact)
        before, here, after = None, self._slice(-1), self._slice(0)
        by_length = {int(n): self._bitsets((self.lengths == n).astype(int), 2)[1] for n in np.unique(self.lengths)}
        none = np.zeros(self.width // 8, np.uint64)
        for i in range(int(self.lengths.max()) + 1):
            start = skip == i
            if i and start.any():
                skipped[start] = exact[start]
            done = np.flatnonzero(self.lengths == i)
            if len(done):
                same, longer, shorter = (by_length.get(i + d, none) for d in (0, 1, -1))
                hit = (replaced[done] & ~exact[done] & same) | (extra[done] & shorter)
                hit |= (missing[done] | exact[done]) & longer
                result[done] = hit & ~skipped[done]
            before, here, after = here, after, self._slice(i + 1)
            letter = self.codes[:, i]
            replaced = (replaced & here[letter]) | exact
            extra = (extra & before[letter]) | exact
            missing = (missing | exact) & after[letter]
            exact = exact & here[letter]
        # Two long words of a group meet again in a group of their length.
        long = self.lengths > s
        result[long] &= ~self._bitsets(long.astype(int), 2)[1]
        return result


def _pack_rows(words: list[str], n: list[int], keys: list[int], skip: list[int], s: list[int]) -> pa.RecordBatch:
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, counts = [words[i] for i in order], np.array(n)[order]
    group, skip, s = (np.array(c)[order] for c in (keys, skip, s))
    bits = np.unpackbits(Pack(words, group).near(group, skip, s).view(np.uint8), axis=1)
    found = bits.sum(axis=1, dtype=np.int64)
    hit, best = np.flatnonzero(found), bits.argmax(axis=1)
    best = best[hit]
    columns = [
        pa.array([words[i] for i in hit], pa.string()),
        pa.array(found[hit]),
        pa.array(counts[best], pa.int64()),
        pa.array([words[i] for i in best], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def _searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come group by group; whole groups are packed together."""
    pack: list[list] = [[], [], [], [], []]  # word, n, number of the group, skip, s
    letters, last = 0, None  # of the pack; the group at work
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("word", "n", "skip", *KEY)]
        for word, n, skip, *key in zip(*columns):
            if key != last:
                # Rows ascend by length: the words of a pack are of similar lengths.
                long = pack[0] and key[0] > 2 * pack[4][0]
                if len(pack[0]) >= PACK or letters >= PACK_LETTERS or long:
                    yield _pack_rows(*pack)
                    pack, letters = [[], [], [], [], []], 0
                last = key
                number = pack[2][-1] + 1 if pack[2] else 0
            for c, v in zip(pack, (word, n, number, skip, key[0])):
                c.append(v)
            letters += len(word)
    if pack[0]:
        yield _pack_rows(*pack)


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best_n, best) for words of ``words`` (distinct word, n) with a near word.

    Words have two letters at least; shorter ones are near nothing here.
    Near words differ by exactly one inserted, deleted or replaced code point; the best one has the
    largest n, of equals the first in code-point order.
    """
    # A column of its own: an exchange on the keys of the join before it could be left out.
    rows = groups(words, limit).withColumn("_group", F.xxhash64(*KEY)).repartition("_group")
    rows = rows.sortWithinPartitions(*KEY).select("word", "n", "skip", *KEY)
    parts = rows.mapInArrow(_searched, "word string, n_near bigint, best_n bigint, best string")
    best = F.min_by(F.struct("best_n", "best"), F.struct(-F.col("best_n"), "best")).alias("b")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms, by doubling; ``forms`` is (word, form).

    n grows at least fivefold along a chain, so there are no cycles and a few rounds reach every end.
    """
    links = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = checkpoint(links.join(ahead, "root", "left"))
        if joined.filter("_next IS NOT NULL").isEmpty():
            return links
        links = joined.select("word", F.coalesce("_next", "root").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``words`` (distinct word, n).

    ``form`` is the best near word if it occurs at least ``ratio`` times as often, else null; ``root`` is
    the end of the chain of forms, the word itself if it has none.
    """
    words = checkpoint(words.select("word", "n"))
    rows = words.join(near_words(words, limit), "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    rows = checkpoint(rows.select(
        "word", F.when(good, F.col("best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(good, F.col("best_n")).alias("form_n"),
    ))
    roots = _roots(rows.filter("form IS NOT NULL"))
    rows = rows.join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the ``vocabulary`` of ``docs``; an empty table gives no rows.

    Null and empty texts have no words, repeated rows count each time, and other columns are not read.
    """
    return variants(vocabulary(docs, id_col=id_col, text=text))
