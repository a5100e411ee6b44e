"""Line dedup by a segment-partition edit join.

A line cut into THRESHOLD + 1 segments keeps at least one of them whole under THRESHOLD edits.  So
every distinct line puts its segments into an index keyed by line length, segment number and text,
and probes it with the substrings that can stand opposite a segment of a line as long or up to
THRESHOLD shorter.  Lines that meet are verified by a banded bit-parallel edit distance: what two
lines share at both ends is cut off first, then one number holds, for each count of edits, the set of
diagonals of the band that can be reached.

Lines are known by the pair of a 64-bit hash and their length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint, new_folder
from .components import roots
from .texts import BLANKS, if_small, let, packed

THRESHOLD = 1
#: Shorter lines are duplicates only if equal: one edit makes another word of them.
LEAST_CHARS = 20
#: Lines that occur more often than this lose all their places but the first.
MOST_TIMES = 6
#: A document that keeps less than this share of its characters is a copy and goes.
LEAST_SHARE = 0.2
#: Index lines under one key that are paired directly; the lines of a fuller key are paired by the
#: segments of what is left of them beside the shared segment.
FULL_KEY = 64
#: Rounds of that; the rest halves each time, so after them it is a few characters.
ROUNDS = 8


def _segment(i: int, parts: int, length: Column) -> tuple[Column, Column]:
    """First position (from 1) and length of segment i (from 0); the last ones take the remainder."""
    base = F.floor(length / parts).cast("int")
    short = F.lit(parts) - F.pmod(length, F.lit(parts)).cast("int")
    start = F.lit(i) * base + F.greatest(F.lit(0), F.lit(i) - short) + 1
    return start, base + F.when(F.lit(i) >= short, 1).otherwise(0)


def segment_keys(
    text: str, length: Column, group: list[str], threshold: int, probes: bool
) -> list[tuple]:
    """(key, at, size) of a line's own segments, or of the substrings that it probes with.

    For a line D characters shorter and its segment i, only those starts are probed from which the
    parts to the left and to the right can both still be matched within the threshold. The key is
    null where the line has no such substring.
    """
    parts, found = threshold + 1, []
    for shorter in range(threshold + 1 if probes else 1):
        for i in range(parts):
            start, size = _segment(i, parts, length - shorter)
            low = max(-i, shorter - (threshold - i)) if probes else 0
            high = min(i, shorter + (threshold - i)) if probes else 0
            for move in range(low, high + 1):
                at = start + move
                piece = F.substring(F.col(text), at, size)
                key = F.xxhash64(*group, F.lit(i), length - shorter, piece)
                fits = (at >= 1) & (at + size - 1 <= length) & (length >= shorter)
                found.append((F.when(fits, key), at, size))
    return found


def _shared(x: str, y: str, limit: Column, cut) -> Column:
    """Characters that two texts share from one end, at most ``limit``, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    small = F.filter(steps, lambda s: s <= limit)

    def grow(known, step):
        same = cut(F.col(x), known, step) == cut(F.col(y), known, step)
        return F.when((known + step <= limit) & same, known + step).otherwise(known)

    return F.aggregate(small, F.lit(0), grow)


def _head(text: Column, known: Column, step: Column) -> Column:
    return F.substring(text, known + 1, step)


def _tail(text: Column, known: Column, step: Column) -> Column:
    return F.substring(text, F.length(text) - known - step + 1, step)


def verified(pairs: DataFrame, x: str, y: str, threshold: int) -> DataFrame:
    """The rows of ``pairs`` whose texts differ by at most ``threshold`` edits of a character."""
    least = F.least(F.length(x), F.length(y))

    def middle(c, head, tail):
        size = F.length(c) - head - tail
        text = F.substring(F.col(c), head + 1, size)
        return F.when(size > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))

    def rest(head):
        return let(
            _shared(x, y, least - head, _tail),
            lambda tail: let(
                F.struct(middle(x, head, tail).alias("x"), middle(y, head, tail).alias("y")),
                lambda m: _reaches(m.x, m.y, threshold),
            ),
        )

    rows = pairs.filter(F.abs(F.length(x) - F.length(y)) <= threshold)
    return rows.filter(let(_shared(x, y, least, _head), rest))


def _reaches(x: Column, y: Column, t: int) -> Column:
    """Whether the characters of y can be reached from those of x.

    Bit e * W + d + t of the state is set if, with at most e edits, the characters of x read so far
    stand opposite as many characters of y plus d. A step reads a character of x: it is matched (same
    diagonal, no edit), replaced (same diagonal) or dropped (one diagonal down); characters of y are
    added (one diagonal up).
    """
    w = 2 * t + 1
    full, every = (1 << w * (t + 1)) - 1, sum(1 << w * e for e in range(t + 1))
    not_lowest = full & ~every

    def may_rise(k):
        return sum(((1 << (w - k)) - 1) << w * e for e in range(t + 1))

    def closed(bits):
        """Add 0 to t characters of y, an edit each."""
        out = bits
        for k in range(1, t + 1):
            up = F.shiftleft(bits.bitwiseAND(F.lit(may_rise(k))), k * (w + 1))
            out = out.bitwiseOR(up.bitwiseAND(F.lit(full)))
        return out

    def opposite(c, i):
        """The diagonals on which the character matches, on every level."""
        hits = F.lit(0)
        for d in range(-t, t + 1):
            other = F.get(y, F.when(i + d >= 0, i + d))
            hits = hits.bitwiseOR(F.when(other == c, 1 << (d + t)).otherwise(0))
        return (hits * every).cast("bigint")

    def step(state, hits):
        replaced = F.shiftleft(state, w).bitwiseAND(F.lit(full))
        dropped = F.shiftleft(state.bitwiseAND(F.lit(not_lowest)), w - 1).bitwiseAND(F.lit(full))
        return closed(state.bitwiseAND(hits).bitwiseOR(replaced).bitwiseOR(dropped))

    start = 0
    for e in range(t + 1):  # before the first character: up to e characters of y added
        start |= sum(1 << (d + t) for d in range(0, e + 1)) << w * e
    end = F.aggregate(
        F.transform(x, opposite),
        F.lit(start).cast("bigint"),
        lambda state, hits: F.when(state == 0, state).otherwise(step(state, hits)),
    )
    apart = F.size(y) - F.size(x)
    place = F.lit(w * t + t) + F.greatest(F.lit(-t), F.least(F.lit(t), apart))
    reached = F.call_function("shiftright", end, place)
    return (F.abs(apart) <= t) & (reached.bitwiseAND(F.lit(1)) == 1)


def _keyed(rows: DataFrame, group: list[str], threshold: int, probes: bool) -> DataFrame:
    """(h, n, key): a row for every segment, or every substring to probe with."""
    keys = [k for k, _, _ in segment_keys("rest", F.col("m"), group, threshold, probes)]
    return rows.select("h", "n", F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL")


def _pairs(rows: DataFrame, group: list[str], threshold: int, last: bool):
    """Candidate pairs (ah, an, bh, bn) of ``rows`` (h, n, rest, m: its length), and the rows under full keys."""
    own, probe = (_keyed(rows, group, threshold, p) for p in (False, True))
    full = None
    if not last:
        full = checkpoint(own.groupBy("key").agg(F.count("*").alias("c")).filter(f"c > {FULL_KEY}"))
        full = None if full.isEmpty() else full.select("key")
    few = own if full is None else own.join(if_small(full), "key", "left_anti")
    found = (
        probe.select("key", F.col("h").alias("ah"), F.col("n").alias("an"))
        .join(few.select("key", F.col("h").alias("bh"), F.col("n").alias("bn")), "key")
        .filter("an > bn OR (an = bn AND ah > bh)")
        .drop("key")
    )
    if full is None:
        return found, None
    # Lines that share a segment: what is left of each has to match within the threshold.
    entries = [
        F.struct(k.alias("key"), at.alias("at"), size.alias("size"))
        for k, at, size in segment_keys("rest", F.col("m"), group, threshold, True)
    ]
    more = rows.select("h", "n", "rest", "m", F.explode(F.array(*entries)).alias("k"))
    more = more.select("h", "n", "rest", "m", "k.*").join(if_small(full), "key")
    beside = F.expr("concat(substring(rest, 1, at - 1), substring(rest, at + size))")
    more = more.select("h", "n", beside.alias("rest"), (F.col("m") - F.col("size")).alias("m"), F.col("key").alias("g"))
    return found, checkpoint(more.distinct())


def line_links(lines: DataFrame, threshold: int = THRESHOLD, least: int = LEAST_CHARS) -> DataFrame:
    """(a, b) of distinct ``lines`` (h, n, line) within ``threshold`` edits, as structs (h, n).

    Only lines of at least ``least`` characters are linked. A segment that many lines share is not
    paired out: the lines under it are joined again on the segments of their rests.
    """
    long = lines.filter(F.col("n") >= max(least, threshold + 1)).select("h", "n", "line")
    rows, group, found = long.select("h", "n", F.col("line").alias("rest"), F.col("n").alias("m")), [], []
    for round_ in range(ROUNDS):
        pairs, rows = _pairs(rows, group, threshold, round_ == ROUNDS - 1)
        found.append(pairs)
        if rows is None:
            break
        group = ["g"]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = checkpoint(pairs.distinct())
    # Only the lines that met somewhere are fetched.
    both = F.explode(F.expr("array(struct(ah AS h, an AS n), struct(bh AS h, bn AS n))")).alias("k")
    met = pairs.select(both).select("k.*").distinct()
    texts = checkpoint(long.join(if_small(met), ["h", "n"]))
    a = texts.selectExpr("h AS ah", "n AS an", "line AS x")
    b = texts.selectExpr("h AS bh", "n AS bn", "line AS y")
    near = verified(pairs.join(a, ["ah", "an"]).join(b, ["bh", "bn"]), "x", "y", threshold)
    return near.selectExpr("struct(ah AS h, an AS n) AS a", "struct(bh AS h, bn AS n) AS b")


def _occurrences(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, version, line_no, line, h, n) of every line with a character that is no blank."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("version"),
        F.posexplode(F.split(text, "\n")).alias("line_no", "line"),
    )
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter("line <> ''")
    return lines.withColumns({"h": F.xxhash64("line"), "n": F.length("line")})


def line_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: int = THRESHOLD,
    least: int = LEAST_CHARS,
    most: int = MOST_TIMES,
    most_long: int | None = None,
) -> DataFrame:
    """One row per line that is not blank: where it stands, the first place of its class, and kept.

    Columns: doc_id, version (hash of the text, which tells apart different texts with one id),
    line_no (from 0), first_doc_id, first_line_no, times (lines of the class), kept. A class holds the
    lines, trimmed of blanks, that are equal or linked by chains of at most ``threshold`` edits. A
    class with more than ``most`` lines (``most_long``, if given, for lines of at least ``least``
    characters) keeps its first place only. Null and blank texts have no
    lines; rows with a null id have no place and give no rows; repeated rows repeat their lines, and
    if one of them is the first place all of them are. Other columns are not read.
    """
    occurrences = _occurrences(docs, id_col, text)
    folder = new_folder(docs.sparkSession, f"lines-{uuid.uuid4().hex[:6]}")
    occurrences.groupBy("h", "n").agg(
        F.first("line").alias("line"),
        F.count("*").alias("times"),
        F.min(F.struct("doc_id", "line_no")).alias("first"),
    ).write.parquet(folder)
    lines = docs.sparkSession.read.parquet(folder)
    root = roots(line_links(lines, threshold, least))
    members = root.union(root.select("root", "root").distinct()).toDF("node", "root")
    members = members.select("node.*", "root")
    totals = lines.drop("line").join(members, ["h", "n"]).groupBy("root")
    totals = totals.agg(F.sum("times").alias("times"), F.min("first").alias("first"))
    linked = members.join(totals, "root").selectExpr("h", "n", "times AS all_times", "first AS of_all")
    # A line that is alone needs no row here.
    classes = lines.drop("line").join(linked, ["h", "n"], "left").filter("times > 1 OR of_all IS NOT NULL")
    classes = classes.select(
        "h", "n", F.coalesce("all_times", "times").alias("times"), F.coalesce("of_all", "first").alias("first")
    )
    here = F.struct("doc_id", "line_no")
    allowed = F.when(F.col("n") >= least, F.lit(most if most_long is None else most_long)).otherwise(most)
    placed = occurrences.drop("line").join(classes, ["h", "n"], "left")
    placed = placed.withColumns(
        {"times": F.coalesce("times", F.lit(1)), "first": F.coalesce("first", here)}
    )
    return placed.select(
        "doc_id",
        "version",
        "line_no",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.line_no").alias("first_line_no"),
        "times",
        ((F.col("times") <= allowed) | (here == F.col("first"))).alias("kept"),
    )


def without_repeated_lines(
    docs: DataFrame, share: float = LEAST_SHARE, most_long: int | None = None
) -> DataFrame:
    """``docs``, all columns, its texts without the lines that ``line_classes`` does not keep.

    ``n_chars``, where there is one, follows the text. A text that loses no line is not touched. A
    document left with blanks only, or with under ``share`` of its characters, goes; with share 0 no
    line is lost that stands nowhere else.
    Rows with a null id or text stay as they are.
    """
    gone = (
        line_classes(docs, most_long=most_long)
        .filter("NOT kept")
        .groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
        .agg(F.collect_set("line_no").alias("_gone"))
    )
    mine = (F.col("row.doc_id") == F.col("_id")) & (F.xxhash64("row.text") == F.col("_version"))
    text = F.col("row.text")
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    rest = F.concat_ws("\n", F.transform(left, lambda i: F.get(lines, i)))
    rows = packed(docs).join(gone, mine, "left")
    rows = rows.withColumn("_rest", F.when(F.col("_gone").isNull(), text).otherwise(rest))
    rows = rows.filter(
        F.col("_gone").isNull()
        | ((F.btrim("_rest", F.lit(BLANKS)) != "") & (F.length("_rest") >= share * F.length(text)))
    )
    changed: dict = {"text": F.col("_rest")}
    if "n_chars" in docs.columns:
        size = F.length("_rest").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("_gone").isNull(), F.col("row.n_chars")).otherwise(size)
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
