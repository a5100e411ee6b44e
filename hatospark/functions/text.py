"""Text equality of the data model: case, accents and trailing blanks do not count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLATION = "UNICODE_CI_AI_RTRIM"


def loose(column: Column | str) -> Column:
    """The column under the collation that ignores case, accents and trailing blanks."""
    return F.collate(F.col(column) if isinstance(column, str) else column, COLLATION)


def exact(column: Column | str) -> Column:
    return F.collate(F.col(column) if isinstance(column, str) else column, "UTF8_BINARY")
