"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over SPAN consecutive tokens; its hash covers the tokens that the mask selects
and ignores the others.  Hashes of the benchmark and of the corpus meet in an equality join, which
also gives the alignment of the two.  Around a hit, aligned tokens are compared: a document is
contaminated if a window of WINDOW tokens agrees with the item but for ALLOWED substitutions.  The
two masks hit every such window, wherever its substitutions are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint
from .texts import if_small, let, packed

#: Token positions that each mask selects.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW, ALLOWED = 13, 2


def token_hashes(text: str | Column) -> Column:
    """Hashes of the lower-cased runs of letters, marks and digits; null for a null text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, at, seed): the hash of every mask at every position of the token hashes ``h``."""
    at = F.explode(F.sequence(F.lit(0), F.size("h") - SPAN)).alias("at")
    rows = rows.filter(F.size("h") >= SPAN).select(*keep, "h", at)
    seeds = [
        F.xxhash64(F.lit(k), *[F.get(F.col("h"), F.col("at") + o) for o in mask])
        for k, mask in enumerate(MASKS)
    ]
    return rows.select(*keep, "at", F.explode(F.array(*seeds)).alias("seed"))


def _best_window() -> Column:
    """(best: equal tokens, at: its place) of the window of ``w`` tokens that agrees best.

    ``mine`` and ``theirs``: the tokens of document and item that stand opposite each other.
    """
    same = F.zip_with("mine", "theirs", lambda a, b: F.when(a == b, 1).otherwise(0))

    def slide(same):
        def step(state, i):
            gone = F.coalesce(F.get(same, F.when(i >= F.col("w"), i - F.col("w"))), F.lit(0))
            n = state.n + F.get(same, i) - gone
            full = i >= F.col("w") - 1
            return F.struct(
                n.alias("n"),
                F.when(full, F.greatest(state.best, n)).otherwise(state.best).alias("best"),
                F.when(full & (n > state.best), i - F.col("w") + 1).otherwise(state.at).alias("at"),
            )

        start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("best"), F.lit(0).alias("at"))
        return F.aggregate(F.sequence(F.lit(0), F.size(same) - 1), start, step)

    return let(same, slide)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per contaminated document and benchmark item, with the window that agrees best.

    Columns: doc_id, version (hash of the text), item_id, doc_start and item_start (token numbers from
    0), n_tokens (the window) and n_equal. Windows have WINDOW tokens, at most ALLOWED of them
    substituted; an item of SPAN to WINDOW - 1 tokens has to occur whole and unchanged; shorter items
    and null texts never match. Equal items count as the one with the least id, equal rows as one;
    null ids are kept as ids. Other columns are not read.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), token_hashes(item_text).alias("ih"))
    items = items.filter(F.size("ih") >= SPAN).groupBy("ih").agg(F.min("item_id").alias("item_id"))
    items = checkpoint(items.withColumn("item", F.xxhash64("ih")))
    index = checkpoint(
        _seeds(items.select("item", F.col("ih").alias("h")), ["item"])
        .select("seed", "item", F.col("at").alias("item_at"))
        .distinct()
    )
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("_t")
    )
    hits = (
        _seeds(texts.select("version", token_hashes("_t").alias("h")), ["version"])
        .join(if_small(index), "seed")
        .select("version", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    hits = checkpoint(hits)
    found = texts.join(if_small(hits.select("version").distinct()), "version").select(
        "doc_id", "version", token_hashes("_t").alias("h")
    )
    found = found.distinct().join(if_small(hits), "version").join(
        if_small(items, F.size("ih")), "item"
    )
    first = F.greatest(F.lit(0), -F.col("shift"))
    n = F.least(F.size("ih"), F.size("h") - F.col("shift")) - first
    # From here on a row holds what stands opposite the item, never the whole document.
    found = found.select(
        "doc_id", "version", "item_id", "shift", first.alias("first"),
        F.size("ih").alias("n_item"), F.least(F.lit(WINDOW), F.size("ih")).alias("w"),
        F.slice("h", first + F.col("shift") + 1, F.greatest(n, F.lit(0))).alias("mine"),
        F.slice("ih", first + 1, F.greatest(n, F.lit(0))).alias("theirs"),
    ).filter(F.size("mine") >= F.col("w"))
    # A one-row explode, so that the filter reads the window instead of computing it again.
    found = found.select("*", F.explode(F.array(_best_window())).alias("best"))
    allowed = F.when(F.col("n_item") >= WINDOW, ALLOWED).otherwise(0)
    found = found.filter(F.col("best.best") >= F.col("w") - allowed)
    start = F.col("first") + F.col("best.at")
    found = found.select(
        "doc_id", "version", "item_id",
        F.struct(
            F.col("best.best").alias("n_equal"), (-(start + F.col("shift"))).alias("minus"),
            start.alias("item_start"), "w",
        ).alias("b"),
    )
    found = found.groupBy("doc_id", "version", "item_id").agg(F.max("b").alias("b"))
    return found.select(
        "doc_id", "version", "item_id",
        (-F.col("b.minus")).alias("doc_start"), F.col("b.item_start").alias("item_start"),
        F.col("b.w").alias("n_tokens"), F.col("b.n_equal").alias("n_equal"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of the benchmark."""
    gone = checkpoint(leaks(docs, benchmark).select("version").distinct())
    mine = F.xxhash64("row.text") == F.col("version")
    return packed(docs).join(if_small(gone), mine, "left_anti").select("row.*")
