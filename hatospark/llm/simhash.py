"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a non-zero vector of RADIUS + 1 bits; the mask of a non-zero vector v keeps
the positions whose vector has an odd product with v.  For up to RADIUS differing positions some v
has even products with all their vectors, so its mask ignores them all: every pair of fingerprints
within the radius agrees under at least one of the 2^(RADIUS + 1) - 1 masks.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint
from .components import roots
from .texts import map_texts, packed

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a bucket that are compared with each other; larger buckets are split first.
BUCKET = 500
#: Shingles whose bits are added up at once.
BLOCK = 1 << 16


def _bits_of_bytes() -> np.ndarray:
    return ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


_BITS = _bits_of_bytes()


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the word shingles, repeats included."""
    data = (text or "").encode("utf-8").lower()  # of bytes: A-Z only
    words = data.split()  # at the six ASCII blanks
    if not words:
        return 0
    joined, k = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(spans), BLOCK):
        hashes = [digest(joined[a:b], SEED) for a, b in spans[at : at + BLOCK]]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[8 * j : 8 * j + 8] += np.bincount(octets[:, j], minlength=256) @ _BITS
    bits = np.packbits(2 * counts > len(spans), bitorder="little")
    return int(bits.view("<i8")[0])


def masks(level: int = 0, radius: int = RADIUS) -> list[int]:
    """The covering masks, as signed 64-bit numbers; each level deals the vectors out anew."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    random.Random(level).shuffle(vectors)
    out = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _near(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def _forest(batches):
    """Links that connect the members of each bucket as all links within the radius would."""
    for batch in batches:
        a, b = [], []
        for members in batch.column("members").to_pylist():
            values = np.array(members, dtype=np.int64)
            apart = np.bitwise_count(values[:, None] ^ values[None, :])
            left = np.ones(len(values), bool)
            for start in range(len(values)):
                queue = [start] if left[start] else []
                left[start] = False
                while queue:
                    x = queue.pop()
                    new = np.flatnonzero(left & (apart[x] <= RADIUS))
                    left[new] = False
                    queue += new.tolist()
                    a += [members[x]] * len(new)
                    b += values[new].tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
        )


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) fingerprints within the radius that connect ``prints`` (distinct ``fp``) like all such pairs.

    A bucket is the set of fingerprints that agree under one mask. Up to ``bucket`` members are
    compared with each other in one task. A larger bucket is split by another set of covering masks:
    its pairs within the radius still meet in some part of it, and the parts agree on more bits, so
    splitting ends however dense the fingerprints lie. No bucket is cut or dropped.
    """
    rows, keys, found, level = prints.select("fp"), [], [], 0
    while True:
        k, v = f"k{level}", f"v{level}"
        each = [F.struct(F.lit(i).alias(k), F.col("fp").bitwiseAND(F.lit(m)).alias(v)) for i, m in enumerate(masks(level))]
        rows = rows.select(*keys, "fp", F.explode(F.array(*each)).alias("_m")).select(*keys, "fp", "_m.*")
        keys += [k, v]
        sizes = rows.groupBy(*keys).agg(
            F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
        )
        sizes = checkpoint(sizes.filter("n > 1"))
        found.append(sizes.filter("n = 2").select("a", "b").filter(_near("a", "b")))
        some = rows.join(sizes.filter(f"n > 2 AND n <= {bucket}").select(*keys), keys)
        members = some.groupBy(*keys).agg(F.collect_list("fp").alias("members")).select("members")
        found.append(members.mapInArrow(_forest, "a bigint, b bigint"))
        large = sizes.filter(f"n > {bucket}")
        if large.isEmpty():
            break
        rows = checkpoint(rows.join(large.select(*keys), keys))
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fingerprints(docs: DataFrame, keep: list[Column], text: str) -> DataFrame:
    def make():
        return lambda value: (fingerprint(value),)

    return checkpoint(map_texts(docs, keep, text, make, "fp bigint"))


def _firsts(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(fp, ``name``): for every fingerprint the least ``value`` of its component."""
    prints = checkpoint(rows.groupBy("fp").agg(F.min(value).alias("least")))
    root = roots(links(prints))
    named = prints.join(root, prints["fp"] == root["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias(name))
    return named.select("fp", "root").join(least, "root").select("fp", name)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    ``component_id`` is the least doc_id reachable over links between fingerprints that differ in
    at most RADIUS bits, the document's own included. Texts without words (null, empty, blank) have
    fingerprint zero and are linked like any other. Repeated rows are copies of each other. A null
    id is never the least one; a component of null ids only has a null component_id. Other columns
    are not read.
    """
    rows = _fingerprints(docs, [F.col(id_col).alias("doc_id")], text)
    classes = _firsts(rows, F.col("doc_id"), "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, of each component: of its first document and text.

    A document is known by its id and the hash of its text, so other texts under an id are judged on
    their own. Of fully or partly repeated rows of the first document one stays. Rows without an id stay.
    """
    keep = [F.col("doc_id"), F.xxhash64("text").alias("version")]
    rows = _fingerprints(docs, keep, "text").filter("doc_id IS NOT NULL")
    first = _firsts(rows, F.struct("doc_id", "version"), "first")
    copies = rows.groupBy("doc_id", "version").agg(F.first("fp").alias("fp"), F.count("*").alias("n"))
    copies = checkpoint(copies.join(first, "fp").select(
        F.col("doc_id").alias("_id"), F.col("version").alias("_version"),
        (F.struct("doc_id", "version") != F.col("first")).alias("gone"), "n",
    ).filter("gone OR n > 1"))
    mine = (F.col("row.doc_id") == F.col("_id")) & (F.xxhash64("row.text") == F.col("_version"))
    kept = packed(docs).join(copies.select("_id", "_version"), mine, "left_anti").select("row.*")
    repeated = copies.filter("NOT gone")
    if repeated.isEmpty():
        return kept
    repeated = packed(docs).join(repeated.select("_id", "_version"), mine)
    return kept.union(repeated.dropDuplicates(["_id", "_version"]).select("row.*"))
