"""Taking rows in: defaults and stored columns are filled and all row rules counted on the way, in one read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..model.columns import Table
from .quality import fill_defaults, with_generated


def row_rules(table: Table, delivered: list[str]) -> dict[tuple[str, str], str]:
    """(kind, name) -> SQL that is true where a row breaks the rule, over the columns that rows bring."""
    rules = {
        ("regla", name): f"NOT ({rule})"
        for name, rule in table.checks.items()
        if rule.split()[0] in delivered
    }
    for c in table.columns:
        if c.name not in delivered:
            continue
        if c.domain:
            rules["dominio", c.name] = f"{c.name} NOT IN ({', '.join(f"'{w}'" for w in c.domain)})"
        if not c.nullable:
            rules["nulo", c.name] = f"{c.name} IS NULL"
        if c.size:
            rules["longitud", c.name] = f"char_length({c.name}) > {c.size}"
    return rules


def take_in(
    rows: DataFrame, table: Table, as_of: str, run_ts: str, folder: str
) -> tuple[int, dict[tuple[str, str], int]]:
    """Write ``rows`` with defaults and stored columns as Parquet to ``folder``; count rows and broken rules.

    No row is refused. The counts are metrics of the write itself, one number per rule; the rows are not read
    again. The write has no shuffle, so every task's counts arrive once, repeated tasks included.
    """
    rules = row_rules(table, rows.columns)
    counts = [F.count(F.when(F.expr(broken), True)).alias(f"r{i}") for i, broken in enumerate(rules.values())]
    seen = Observation()
    full = with_generated(fill_defaults(rows, table, as_of, run_ts), table)
    full.observe(seen, F.count("*").alias("filas"), *counts).write.parquet(folder)
    found = seen.get
    return found["filas"], {rule: found[f"r{i}"] for i, rule in enumerate(rules)}
