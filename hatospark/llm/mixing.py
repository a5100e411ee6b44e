"""Mixing sources to target weights at exact word budgets.

Every document gets a random-looking key from a hash of its id.  Within a source, documents are
taken in key order: whole passes over the source first, then the head of one more pass that a prefix
sum of the sizes cuts exactly where the budget ends.  Keys are uniform, so equal ranges of them are
the range partitions of the sort; sums per range travel in a small table, and no task ever holds a
whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint
from .texts import WORD, packed

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of the corpus, and the most that a source may be repeated.
SHARE, MOST = 1.5, 2.0
#: Rows that a range of keys holds on average.
RANGE_ROWS = 2000


def size_of(text: str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def key_of(id_col: str) -> Column:
    """A number in [0, 2^60) from the id's MD5, the same on every engine."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``sources`` (one row per source: source, source_size, n_docs) with ``target``.

    All sizes times ``share`` are dealt out by weight.  No target goes over ``most`` times its
    source's size; the excess is dealt out again by weight among the others.  That ends at one level L
    with target = min(cap, L * weight): the sources that reach their cap are the first in order of
    cap over weight, so running sums in that order give L without rounds.
    Once the level is passed it falls again, so it is the highest among those that cap no more.
    The table has one row per source; both windows below run over those rows only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place + 1).cast("int"))
    rows = sources.withColumn("_w", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    done = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("_cap").over(done), F.lit(0.0))) / F.sum("_w").over(left)
    rows = rows.withColumn("_level", level).withColumn(
        "_open", F.col("_level") * F.col("_w") <= F.col("_cap")
    )
    level = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return rows.withColumn("target", target.cast("double")).drop("_w", "_cap", "_level", "_open")


def taken(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` (row, source, size, key) with its source's size and target, and ``taken``.

    ``taken`` are the words that the mix takes of the document: ``size`` for each whole pass, and
    what the last pass still takes.  A source's sum is its target, rounded to a whole word.
    """
    info = sources.withColumn("_ranges", F.ceil(F.col("n_docs") / RANGE_ROWS))
    info = info.select(
        F.col("source").alias("_of"), "source_size", "target", "_ranges",
        F.floor(F.round("target") / F.greatest("source_size", F.lit(1))).alias("_passes"),
    )
    # Uniform keys: equal ranges hold equal shares of a source, however large it is.
    rows = sized.join(info, sized["source"].eqNullSafe(info["_of"])).withColumn(
        "_range", F.floor(F.shiftright("key", 28) * F.col("_ranges") / 2**32)
    )
    before = (Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_of", "_range").agg(F.sum("size").alias("_sum"))
    ranges = ranges.select(
        F.col("_of").alias("_of2"), F.col("_range").alias("_range2"),
        F.coalesce(
            F.sum("_sum").over(Window.partitionBy("_of").orderBy("_range").rowsBetween(*before)),
            F.lit(0),
        ).alias("_carry"),
    )
    inside = Window.partitionBy("_of", "_range").orderBy("key", "doc_id", "_tie").rowsBetween(*before)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(
        ranges, F.col("_of").eqNullSafe(F.col("_of2")) & (F.col("_range") == F.col("_range2"))
    )
    rest = F.round("target").cast("bigint") - F.col("_passes") * F.col("source_size")
    last = F.greatest(F.lit(0), F.least("size", rest - F.col("_carry") - F.col("_within")))
    return rows.withColumn("taken", (F.col("_passes") * F.col("size") + last).cast("bigint")).drop(
        "_of", "_of2", "_ranges", "_passes", "_range", "_range2", "_carry", "_within"
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    Null texts have size 0; a null source is a source, the last in order; empty sources get
    target 0. Null ids and repeated rows count like any other (ties in the key go by id, then
    text hash; equal rows are interchangeable). Other columns are not read.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        size_of(text).alias("size"),
        key_of(id_col).alias("key"),
        F.xxhash64(text).alias("_tie"),
    )
    return _mixed(sized, weights, share, most).drop("_tie")


def _mixed(sized: DataFrame, weights, share: float, most: float) -> DataFrame:
    # Narrow rows, written once: the texts are read a single time.
    sized = checkpoint(sized)
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    return taken(sized, targets(sums, weights, share, most)).drop("key", "n_docs")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target and taken; columns of these names go."""
    added = ("size", "source_size", "target", "taken")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    source = F.col("row.source").cast("string").alias("source")
    place = F.struct(F.col("row.doc_id"), source, F.xxhash64("row.text").alias("_tie"))
    sized = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        size_of("text").alias("size"),
        key_of("doc_id").alias("key"),
        F.xxhash64("text").alias("_tie"),
    )
    # Repeated rows get the same numbers each: what all of them take, dealt out evenly.
    found = _mixed(sized, weights, share, most).groupBy("doc_id", "source", "_tie").agg(
        *[F.max(c).alias(c) for c in added[:3]], F.floor(F.avg("taken")).alias("taken")
    )
    found = found.select(F.struct("doc_id", "source", "_tie").alias("place"), *added)
    return packed(docs).withColumn("place", place).join(found, "place").select("row.*", *added)
