"""A Merkle manifest of a dataset, by time-forward processing.

Every row is a leaf of its group's tree; the groups' roots are the leaves of one more tree.  A node
is labelled by its level and place, and labels ascend from children to parents.  Sweeping the nodes
in label order, a priority queue hands each node the digests that its children sent to its label;
the node sends its own digest to its parent's label.  The reversed sweep sends the siblings on the
way to the root, a suffix of every proof below, from parents to children until it reaches the leaves.

The queue lies outside memory: a task sweeps a block, ``2**BITS`` consecutive nodes of a tree and all
above them that depend on no other block, with a queue of its own; messages that leave a block are
rows, which the next round's shuffle hands to the block of their label.  A round makes a tree
``2**BITS`` times narrower, so a trillion leaves take five rounds, and no task holds more than a
block however large a group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpoint

#: Fields of a leaf, in order, and the field that names its tree.
FIELDS, GROUP = ("doc_id", "source", "lang", "n_chars", "text"), "lang"
#: Levels that a task goes up in one round.
BITS = 8
#: One entry of a path a level: on which side of the node its sibling stands, and the sibling.
LEFT, RIGHT, NONE = "<", ">", "."


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(values: Iterable[Column]) -> Column:
    """SHA-256 (hex) of the values, each ``-`` if null, else UTF-8 byte count, colon, value."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of all nodes up to ``levels`` above ``digests``, in label order."""
    queue = [(0, place, 0, digest) for place, digest in enumerate(digests)]  # sorted, so a heap
    nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    while queue:
        level, place, _, digest = heappop(queue)
        if level:
            while queue and queue[0][:2] == (level, place):
                digest += heappop(queue)[3]
            digest = H(digest)
        nodes[level].append(digest)
        if level < levels:
            heappush(queue, (level + 1, place >> 1, place & 1, digest))
    return nodes


def backward(nodes: list[list[str]], suffix: str) -> list[str]:
    """The path of every leaf of ``forward``'s nodes; ``suffix`` is the path above them."""
    queue = [(1 - len(nodes), 0, suffix)]
    paths = []
    while queue:
        level, place, above = heappop(queue)
        if not level:
            paths.append(above)
            continue
        below = nodes[-level - 1]
        for child in (2 * place, 2 * place + 1):
            if child < len(below):
                other = child ^ 1
                side = NONE if other >= len(below) else (LEFT if other < child else RIGHT) + below[other]
                heappush(queue, (level + 1, child, side + above))
    return paths


def siblings(path: str) -> str:
    """The siblings of a path, level by level."""
    return path.replace(LEFT, "").replace(RIGHT, "").replace(NONE, "")


def folded(digest: str, path: str) -> str:
    """The root that ``digest`` leads to along ``path``."""
    at = 0
    while at < len(path):
        side, other = path[at], path[at + 1 : at + 65]
        if side == NONE:
            digest, at = H(digest), at + 1
        else:
            digest, at = H(other + digest if side == LEFT else digest + other), at + 65
    return digest


def _levels(n: int, bits: int) -> int:
    """Levels that a block of a tree with ``n`` nodes goes up: to the root if that is within reach."""
    return min(bits, (n - 1).bit_length())


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their ``tree`` by ``order``, and ``n``, the tree's rows.

    Range-sorted; what the ranges before hold comes from a table of one row per tree and range.
    """
    rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = checkpoint(rows.withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree", "part", "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("carry"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    pos = F.col("carry") + F.col("at") - F.col("first")
    return rows.join(parts, ["tree", "part"]).withColumn("pos", pos).drop("at", "part", "first", "carry")


def _in_order(table: pa.Table) -> tuple[pa.Table, int]:
    table = table.sort_by("pos")
    return table, table.column("n")[0].as_py()


def _rises(nodes: DataFrame, bits: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The rounds upwards: (nodes of the round, roots found in it), and all roots (tree, digest)."""

    def up(key: tuple, table: pa.Table) -> pa.Table:
        table, n = _in_order(table)
        top = forward(table.column("digest").to_pylist(), _levels(n, bits))[-1][0]
        row = [(key[0].as_py(), key[1].as_py(), -(-n >> bits), top)]
        return pa.table([pa.array(c) for c in zip(*row)], names=["tree", "pos", "n", "digest"])

    rounds = []
    while True:
        blocks = nodes.select("tree", "pos", "n", "digest", F.shiftright("pos", bits).alias("block"))
        tops = blocks.groupBy("tree", "block").applyInArrow(up, "tree string, pos long, n long, digest string")
        tops = checkpoint(tops)
        rounds.append((nodes, tops.filter("n = 1").select("tree", "digest")))
        nodes = tops.filter("n > 1")
        if nodes.isEmpty():
            break
    roots = rounds[0][1]
    for _, more in rounds[1:]:
        roots = roots.union(more)
    return rounds, roots


def _falls(rounds: list, above: DataFrame, bits: int) -> DataFrame:
    """``above`` (tree, path, subroot, root) handed down: (item, digest, path, subroot, root) of leaves."""

    def down(nodes: pa.Table, tops: pa.Table) -> pa.Table:
        nodes, n = _in_order(nodes)
        top = {c: tops.column(c)[0].as_py() for c in ("path", "subroot", "root")}
        paths = backward(forward(nodes.column("digest").to_pylist(), _levels(n, bits)), top["path"])
        same = [pa.array([top[c]] * len(paths), pa.string()) for c in ("subroot", "root")]
        columns = {"path": pa.array(paths, pa.string()), "subroot": same[0], "root": same[1]}
        for c in ("tree", "pos", "digest", "item"):
            if c in nodes.column_names:
                columns[c] = nodes.column(c)
        return pa.table(columns)

    messages = None
    for depth, (nodes, roots) in reversed(list(enumerate(rounds))):
        done = roots.select("tree").join(above, "tree").withColumn("block", F.lit(0).cast("long"))
        here = done if messages is None else done.unionByName(messages)
        blocks = nodes.withColumn("block", F.shiftright("pos", bits)).groupBy("tree", "block")
        schema = "path string, subroot string, root string, tree string, pos long, digest string"
        if depth == 0:
            item = nodes.schema["item"].dataType.simpleString()
            schema += f", item {item}"
        here = blocks.cogroup(here.groupBy("tree", "block")).applyInArrow(down, schema)
        messages = here.select("tree", F.col("pos").alias("block"), "path", "subroot", "root")
    return here.select("item", "digest", "path", "subroot", "root")


def proofs(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """``leaves`` (tree, digest, item; item.id orders a tree) with path, subroot and root.

    ``path`` is the whole proof of a leaf: for each level, from its own up to the root of all, the side
    and digest of the sibling, or a mark where a run has no other member. Equal ids are ordered by
    digest; equal leaves are interchangeable.
    """
    leaves = leaves.withColumns({"id": F.col("item.id"), "copy": F.monotonically_increasing_id()})
    rounds, subroots = _rises(placed(checkpoint(leaves), ["id", "digest", "copy"]).drop("id", "copy"), bits)
    # The trees' roots are the leaves of one more tree, in order of their names.
    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = placed(top, ["name"]).withColumn("item", F.struct("name")).drop("name")
    top_rounds, roots = _rises(top, bits)
    start = roots.select("tree", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    above = checkpoint(_falls(top_rounds, start, bits))
    above = above.select(F.col("item.name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return _falls(rounds, above, bits)


def dataset_leaves(
    docs: DataFrame, fields=FIELDS, group: str = GROUP, id_col: str = "doc_id", claim: Column | None = None
) -> DataFrame:
    """(tree, digest, item): a leaf per row of ``docs``; ``item`` holds the id and ``claim``.

    Trees are named so that they order by bytes, the null group first.
    """
    name = F.col(group).cast("string")
    claim = F.lit(None).cast("string") if claim is None else claim
    return docs.select(
        F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name)).alias("tree"),
        leaf_digest(map(F.col, fields)).alias("digest"),
        F.struct(F.col(id_col).alias("id"), claim.alias("claim")).alias("item"),
    )


def dataset_proofs(docs: DataFrame, fields=FIELDS, group: str = GROUP, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, path, subroot, root (see ``proofs``)."""
    return proofs(dataset_leaves(docs, fields, group, id_col)).select(
        F.col("item.id").alias("doc_id"), F.col("digest").alias("leaf"), "path", "subroot", "root"
    )


def _checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaf, claim, paths = (batch.column(c).to_pylist() for c in ("leaf", "claim", "path"))
        named = [batch.column(c) for c in ("doc_id", "leaf", "subroot", "root")]
        sums = pa.array([H(siblings(p)) for p in paths], pa.string())
        found = pa.array([folded(c or d, p) for d, c, p in zip(leaf, claim, paths)], pa.string())
        yield pa.RecordBatch.from_arrays(
            [*named, sums, found], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
        )


def manifest(docs: DataFrame, tampered_one_in: int = 7) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows whose id has a CRC-32 that ``tampered_one_in`` divides are checked with one character more
    than they have (a null count stays null); a null id is never tampered with. A null ``lang`` is a group,
    null fields are ``-``, repeated rows are leaves like any other; an empty table has no rows. Columns
    other than FIELDS are not read.
    """
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    values = [one_more if c == "n_chars" else F.col(c) for c in FIELDS]
    chosen = (F.crc32(F.col("doc_id").cast("string")) % tampered_one_in == 0) & F.col("n_chars").isNotNull()
    claim = F.when(chosen, leaf_digest(values))
    found = proofs(dataset_leaves(docs, claim=claim)).select(
        F.col("item.id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("item.claim").alias("claim"),
        "path", "subroot", "root",
    )
    schema = "leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}"
    return found.mapInArrow(_checked, schema).withColumn("verified", F.expr("folded_root = root"))
