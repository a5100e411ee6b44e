"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.derived import Tables, with_tables
from . import changes, commands, cycles, maintenance, quality, reports, snapshots, streams
from .settings import AS_OF, RUN_TS

MODULES = (reports, maintenance, changes, snapshots, streams, commands, cycles, quality)

_tables: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables of a directory; the outputs of one operator share its plan."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = Tables(spark, sf_dir, AS_OF, RUN_TS)
    return _tables[key]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(tables(spark, sf_dir))

    return {name: bind(build) for m in MODULES for name, build in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(sql) for m in MODULES for name, sql in m.ORACLE.items()}


def forget() -> None:
    """Drop the shared plans, so that the next call plans from scratch."""
    _tables.clear()
