"""Quality rules whose thresholds come from quantile sketches per language and source.

A sketch counts values in bins of growing width (each bound is ``GROWTH`` times the one before), so
sketches of parts of the data add up to the sketch of all of it, whatever the order, and a quantile
is off by at most half a bin.  Documents outside their own group's fences are filtered out by a join.
Groups too small to judge take the fences of all groups' sketches together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint
from .texts import BLANKS, map_texts

GROWTH, LEAST = 1.02, 1e-4
#: Fences lie FENCE spreads beyond the quartiles; a spread is the interquartile range and a little
#: slack, so that a group whose texts are all alike tolerates small differences.
FENCE = 3.0
SLACK = {"symbol_share": 0.01, "dup_line_share": 0.1, "repeat_share": 0.05, "word_length": 0.1}
#: Groups of fewer rows (that pass the base rules) are too small to judge by themselves.
SMALL_GROUP = 20
LOW_WORDS, HIGH_REPEAT_PERCENT = 50, 50
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows, lines."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return n, chars, symbols, len(lines) - len(set(lines)), _repeated(words), len(lines)


def _repeated(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(known) + ids[1:]
    pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(known) + ids[2:]
    _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def _share(part: str, whole: Column) -> Column:
    return F.col(part) / F.greatest(whole, F.lit(1))


def measured(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep``, the counts of each whole text, and ``base_failed``."""

    def make():
        return text_counts

    rows = map_texts(docs, keep, text, make, COUNTS)
    return rows.withColumn(
        "base_failed",
        (F.col("n_words") < LOW_WORDS)
        | (100 * F.col("n_repeat_words") > HIGH_REPEAT_PERCENT * F.col("n_words")),
    )


def metrics() -> dict[str, Column]:
    words = F.col("n_words")
    return {
        "symbol_share": _share("n_symbols", words),
        "dup_line_share": _share("n_dup_lines", F.col("n_lines")),
        "repeat_share": _share("n_repeat_words", words),
        "word_length": _share("word_chars", words),
    }


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per group, metric and bin: bin k holds the values in (LEAST * GROWTH^(k-1), LEAST * GROWTH^k]."""
    named = [F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in metrics().items()]
    bin_of = F.greatest(F.ceil(F.log(F.col("m.value") / LEAST) / np.log(GROWTH)), F.lit(0))
    return (
        rows.select(*keys, F.explode(F.array(*named)).alias("m"))
        .select(
            *keys,
            "m.metric",
            F.when(F.col("m.value") > LEAST, bin_of).otherwise(0).cast("int").alias("bin"),
        )
        .groupBy(*keys, "metric", "bin")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group, ``n`` (its rows) and the low and high fence of each metric, from its sketch alone."""
    group = [*keys, "metric"]
    upto = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "all", F.sum("n").over(Window.partitionBy(*group))
    )
    value = F.when(F.col("bin") == 0, 0.0).otherwise(LEAST * F.pow(F.lit(GROWTH), F.col("bin") - 0.5))

    def quantile(q):
        return F.min(F.when(F.col("upto") >= q * F.col("all"), value))

    slack = F.coalesce(*[F.when(F.col("metric") == m, F.lit(x)) for m, x in SLACK.items()])
    spread = FENCE * (F.col("q3") - F.col("q1") + slack)
    both = F.struct((F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    return (
        ranked.groupBy(*group)
        .agg(quantile(0.25).alias("q1"), quantile(0.75).alias("q3"), F.max("all").alias("n"))
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.map_from_entries(F.collect_list(F.struct("metric", both))).alias("fences"),
        )
    )


def judged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``kept`` to measured rows: they pass the base rules and stay within their group's fences.

    Sketches are built from the rows that pass the base rules. Null keys are a group of their own.
    A group has one row of fences, so the join repeats nothing. Sketches add up, so those of all
    groups give the fences of groups under ``SMALL_GROUP`` rows.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    sketch = sketches(rows.filter(~F.col("base_failed")), keys)
    overall = fences(sketch.groupBy("metric", "bin").agg(F.sum("n").alias("n")), [])
    own = F.when(F.col("n") >= SMALL_GROUP, F.col("fences"))
    found = fences(sketch, keys).withColumn("fences", F.coalesce(own, overall.select("fences").scalar()))
    found = found.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "fences")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    within = F.lit(True)
    for name, value in metrics().items():
        fence = F.col("fences")[name]
        within = within & (value >= fence["low"]) & (value <= fence["high"])
    return (
        rows.join(found, same, "left")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))
        .drop(*names, "fences")
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, the counts, ``base_failed`` and ``kept``.

    A null text has no words (base_failed). Null languages and sources form groups; null ids and
    repeated rows come back as they are. Other columns are not read.
    """
    keys = ["_lang", "_source"]
    keep = [F.col(id_col), F.col(lang).alias("_lang"), F.col(source).alias("_source")]
    # Narrow rows, written once: the texts are measured a single time.
    return judged(checkpoint(measured(docs, keep, text)), keys).drop(*keys)
