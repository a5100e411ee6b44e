"""Row-wise work on whole texts: Arrow batches in, one result row per text out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Word separators of the word-based operators: space, tab, newline, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id) -> F.Column:
    """The fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


#: Rows up to which a table of a few numbers a row is broadcast; a larger one is joined by shuffle.
#: Rows that hold arrays count as many times as they hold numbers.
BROADCAST_ROWS = 2_000_000


def if_small(table: DataFrame, numbers: F.Column | None = None) -> DataFrame:
    """``table``, to be broadcast if it was counted to be small; ``numbers``: how many a row holds."""
    size = table.agg(F.count("*") if numbers is None else F.sum(numbers)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_ROWS else table


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` as one column ``row``, so that no column of it clashes with an operator's own."""
    return rows.select(F.struct("*").alias("row"))


def let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_batches(
    rows: DataFrame,
    keep: list[F.Column],
    text: str,
    make: Callable[[], Callable[[list[str | None]], list[tuple]]],
    schema: str,
) -> DataFrame:
    """The columns ``keep`` and, for each row, what ``make()`` returns for the texts of its batch.

    ``make`` runs once in each task and sets up what the texts share (a vocabulary, a model).
    Batches are turned into results one at a time, so a task holds one batch of texts.
    """
    added = _parse_datatype_string(schema)
    table = rows.select(*keep, F.col(text).alias("_text"))
    kept = table.drop("_text").schema.fields
    arrow = to_arrow_schema(StructType(added.fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            results = each(batch.column("_text").to_pylist())
            columns = list(zip(*results)) if results else [()] * len(arrow)
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
            names = [f.name for f in kept] + [f.name for f in arrow]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(kept))] + arrays, names=names
            )

    return table.mapInArrow(run, StructType([*kept, *added.fields]))


def map_texts(
    rows: DataFrame,
    keep: list[F.Column],
    text: str,
    make: Callable[[], Callable[[str | None], tuple]],
    schema: str,
) -> DataFrame:
    """``map_batches`` with a function of a single text."""

    def each():
        one = make()
        return lambda texts: [one(t) for t in texts]

    return map_batches(rows, keep, text, each, schema)
