"""Data quality over whole tables: references, keys, row rules, derived columns,
and the effect of deleting or renaming keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import loose
from ..functions.checkpoints import checkpoint
from ..functions.keysets import not_in
from ..model.columns import AS_OF, CASCADE, RESTRICT, RUN_TS, Table
from ..model.columns import Column as ColumnRule
from ..model.tables import TABLES, children_of

Source = Callable[[str], DataFrame]

#: Up to 200 shares a task writes its rows straight to the shares' files; for more it sorts them in memory first.
MOST_SHARES = 200


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# -- derivations -----------------------------------------------------------------


def default_of(column: ColumnRule, as_of: str, run_ts: str) -> str:
    """The declared default as typed SQL; NULL where none is declared."""
    value = {AS_OF: as_of, RUN_TS: run_ts}.get(column.default, column.default)
    literal = "NULL" if value is None else str(value) if isinstance(value, (bool, int)) else f"'{value}'"
    return f"CAST({literal} AS {column.type.simpleString()})"


def fill_defaults(df: DataFrame, table: Table, as_of: str, run_ts: str) -> DataFrame:
    """Add every column the rows do not bring, with its default, in declared order."""
    present = set(df.columns)
    return df.selectExpr(
        *(
            c.name if c.name in present else f"{default_of(c, as_of, run_ts)} AS {c.name}"
            for c in table.columns
        )
    )


def with_generated(df: DataFrame, table: Table) -> DataFrame:
    """Compute the stored derived columns, rounded to their declared scale; NULL beyond their range."""
    return df.withColumns(
        {name: F.expr(e).try_cast(type_) for name, (e, type_) in table.generated.items()}
    )


# -- checks ----------------------------------------------------------------------


def _entries(source: Source, table: Table, structs: list[str], keep: str) -> DataFrame:
    """One row per struct and row; reads only the columns the structs name."""
    rows = source(table.name)
    name = f"'{table.name}' AS tabla"
    if len(structs) == 1:
        entries = rows.selectExpr(name, f"{structs[0]} AS s").select("tabla", "s.*")
    else:
        entries = rows.selectExpr(name, f"inline(array({', '.join(structs)}))")
    return entries.filter(keep)


def _named(number: str, names: list[str], alias: str) -> str:
    """SQL for the name a number stands for; counting and joining go by number."""
    return f"element_at(array({', '.join(repr(n) for n in names)}), {number} + 1) AS {alias}"


def orphans(source: Source, columns_of: Callable[[str], list[str]]) -> DataFrame:
    """Reference values without a parent, with the number of rows that hold them.

    References are counted map-side (a value held by a third of all rows costs one row).  The parents' keys
    become bitmaps map-side as well, read from the key columns alone, so no key is shuffled on its
    own; counted references look themselves up bucket by bucket.
    """
    rules = [(t.name, c) for t in TABLES.values() for c in t.references if c.name in set(columns_of(t.name))]
    parents = list(dict.fromkeys(c.parent for _, c in rules))
    held = []
    for table in TABLES.values():
        structs = [
            f"struct({n} AS regla, {parents.index(c.parent)} AS p, CAST({c.name} AS BIGINT) AS clave)"
            for n, (name, c) in enumerate(rules)
            if name == table.name
        ]
        if structs:
            held.append(_entries(source, table, structs, "clave IS NOT NULL").drop("tabla"))
    counted = _union(held).groupBy("regla", "p", "clave").agg(F.count("*").alias("filas"))
    known = _union(
        [
            source(name).selectExpr(f"{i} AS p", f"CAST({TABLES[name].key} AS BIGINT) AS clave")
            for i, name in enumerate(parents)
        ]
    )
    return not_in(counted, known, ["p"], "clave").selectExpr(
        _named("regla", [t for t, _ in rules], "tabla"),
        _named("regla", [c.name for _, c in rules], "columna"),
        _named("p", parents, "padre"),
        "clave",
        "filas",
    )


def _as_number(table: Table, column: str) -> str:
    is_day = table.column(column).type == T.DateType()
    return f"CAST(unix_date({column}) AS BIGINT)" if is_day else f"CAST({column} AS BIGINT)"


def _as_text(table: Table, column: str, number: str) -> str:
    is_day = table.column(column).type == T.DateType()
    value = f"date_from_unix_date(CAST({number} AS INT))" if is_day else number
    return f"CAST({value} AS STRING)"


def duplicate_keys(
    source: Source, columns_of: Callable[[str], list[str]], shares: int = MOST_SHARES
) -> DataFrame:
    """Primary and unique keys held by more than one row; a NULL never collides.

    Keys of numbers and days are counted as numbers, keys with text by the
    collation of the model; ``clave`` then shows the smallest spelling.
    Nearly all keys are held once, so counting them where they are read would keep them all in memory
    for nothing: numbers are dealt into ``shares`` by key, uncounted, and each share is counted whole.
    """
    plain, textual, rules, shown = [], [], [], []
    for table in TABLES.values():
        delivered = set(columns_of(table.name))
        numbers, texts = [], []
        for key in ((table.key,), *table.unique):
            if not delivered.issuperset(key):
                continue
            if any(table.column(c).type == T.StringType() for c in key):
                value = " || '|' || ".join(f"CAST({c} AS STRING)" for c in key)
                texts.append(f"struct('{'+'.join(key)}' AS restriccion, {value} AS clave)")
                continue
            second = _as_number(table, key[1]) if len(key) > 1 else "0L"
            numbers.append(f"struct({len(rules)} AS regla, {_as_number(table, key[0])} AS k1, {second} AS k2)")
            text = " || '|' || ".join(_as_text(table, c, k) for c, k in zip(key, ("k1", "k2")))
            shown.append(f"WHEN {len(rules)} THEN {text}")
            rules.append((table.name, "+".join(key)))
        if numbers:
            plain.append(_entries(source, table, numbers, "k1 IS NOT NULL AND k2 IS NOT NULL").drop("tabla"))
        if texts:
            textual.append(_entries(source, table, texts, "clave IS NOT NULL"))
    by_value = (
        _union(plain)
        .repartition(shares, "regla", "k1", "k2")
        .groupBy("regla", "k1", "k2")
        .agg(F.count("*").alias("filas"))
        .filter("filas > 1")
        .selectExpr(
            _named("regla", [t for t, _ in rules], "tabla"),
            _named("regla", [r for _, r in rules], "restriccion"),
            f"CASE regla {' '.join(shown)} END AS clave",
            "filas",
        )
    )
    by_text = (
        _union(textual)
        .withColumn("k", loose("clave"))
        .groupBy("tabla", "restriccion", "k")
        .agg(F.min("clave").alias("clave"), F.count("*").alias("filas"))
        .filter("filas > 1")
        .drop("k")
    )
    return by_value.unionByName(by_text)


def broken_checks(source: Source, columns_of: Callable[[str], list[str]]) -> DataFrame:
    """Rows for which a declared row rule is false; an unknown outcome passes."""
    frames = []
    for table in TABLES.values():
        delivered = columns_of(table.name)
        structs = [
            f"struct('{name}' AS regla, NOT ({rule}) AS rota, CAST({table.key} AS BIGINT) AS clave)"
            for name, rule in table.checks.items()
            if rule.split()[0] in delivered
        ]
        if structs:
            frames.append(_entries(source, table, structs, "rota").drop("rota"))
    return _union(frames)


def outside_domain(source: Source, columns_of: Callable[[str], list[str]]) -> DataFrame:
    """Values that are not one of the words their column accepts."""
    frames = []
    for table in TABLES.values():
        delivered = set(columns_of(table.name))
        structs = []
        for c in table.columns:
            if c.domain and c.name in delivered:
                words = ", ".join(f"'{w}'" for w in c.domain)
                structs.append(
                    f"struct('{c.name}' AS columna, "
                    f"CASE WHEN {c.name} NOT IN ({words}) THEN {c.name} END AS valor, "
                    f"CAST({table.key} AS BIGINT) AS clave)"
                )
        if structs:
            frames.append(_entries(source, table, structs, "valor IS NOT NULL"))
    return _union(frames)


def nulls_and_lengths(source: Source, columns_of: Callable[[str], list[str]]) -> DataFrame:
    """NULLs in mandatory columns and texts longer than declared."""
    frames = []
    for table in TABLES.values():
        delivered = set(columns_of(table.name))
        rules = []
        for c in table.columns:
            if c.name not in delivered:
                continue
            if not c.nullable:
                rules.append((c.name, "nulo", f"{c.name} IS NULL"))
            if c.size:
                rules.append((c.name, "longitud", f"char_length({c.name}) > {c.size}"))
        if rules:
            structs = [
                f"struct('{name}' AS columna, '{what}' AS problema, {broken} AS roto, "
                f"CAST({table.key} AS BIGINT) AS clave)"
                for name, what, broken in rules
            ]
            frames.append(_entries(source, table, structs, "roto").drop("roto"))
    return _union(frames)


# -- deleted and renamed keys ------------------------------------------------------


def delete_rows(source: Source, table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """Delete rows of ``table`` by key and follow every reference to them.

    Returns the rewritten tables, and under ``bloqueados`` the keys that stay
    because a restricting reference holds them (directly or below a cascade).
    The closure over the references is one relation (table, key), written once, level by level
    (there are as many levels as tables in a row that cascade); every output joins it.
    """
    key = TABLES[table].key
    roots = (
        source(table)
        .join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")
        .select(F.lit(table).alias("tabla"), F.col(key).alias("victim"), F.col(key).alias("root"))
    )
    level, written, victims = [table], [checkpoint(roots)], {table}
    while level:
        # One narrow relation per level of references: rows that go with a root, and roots that are held.
        frames, below = [], []
        for parent in level:
            gone = written[-1].filter(F.col("tabla") == parent).drop("tabla")
            for child, column in children_of(parent):
                if column.on_delete not in (RESTRICT, CASCADE):
                    continue
                rows = source(child.name).select(
                    F.col(child.key).alias("child"), F.col(column.name).alias("victim")
                )
                if column.on_delete == RESTRICT:
                    held = gone.join(rows.select("victim").distinct(), "victim", "left_semi")
                    frames.append(held.selectExpr("CAST(NULL AS STRING) AS tabla", "CAST(NULL AS BIGINT) AS victim", "root"))
                else:
                    found = rows.join(gone, "victim").select("child", "root")
                    frames.append(found.selectExpr(f"'{child.name}' AS tabla", "CAST(child AS BIGINT) AS victim", "root"))
                    below.append(child.name)
        if frames:
            written.append(checkpoint(_union(frames).distinct()))
        level = list(dict.fromkeys(below))
        victims.update(level)
    closed = _union([w.select("tabla", F.col("victim").cast("bigint"), "root") for w in written])
    blocked = checkpoint(closed.filter("tabla IS NULL").select("root").distinct())
    free = checkpoint(
        closed.filter("tabla IS NOT NULL").join(blocked, "root", "left_anti")
        .select("tabla", F.col("victim").alias("gone")).distinct()
    )
    deleted = {name: free.filter(F.col("tabla") == name).select("gone") for name in victims}
    out = {"bloqueados": blocked.select(F.col("root").alias(key))}
    nulled: dict[str, list] = {}
    for parent in victims:
        for child, column in children_of(parent):
            if column.on_delete not in (RESTRICT, CASCADE):
                nulled.setdefault(child.name, []).append((column.name, parent))
    for name in {*victims, *nulled}:
        df = source(name)
        if name in deleted:
            df = df.join(deleted[name], F.col(TABLES[name].key) == F.col("gone"), "left_anti")
        for column, parent in nulled.get(name, []):
            df = (
                df.join(deleted[parent], F.col(column) == F.col("gone"), "left")
                .withColumn(column, F.when(F.col("gone").isNull(), F.col(column)))
                .drop("gone")
            )
        out[name] = df
    return out


def _blocked_down(renames: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``old`` keys of ``renames`` whose new key is held by a row that keeps it, directly or in the end.

    Old and new keys are unique, so renames form chains and rings. A link leads on where the new key is that
    of a row that wants to move itself; the last link of a chain decides for all of it. Each round
    doubles the links that a pointer spans, so a chain of n links takes log2(n) rounds; rings
    have no last link and move. ``keys`` are those of the table, as ``new``.
    """
    held = renames.join(keys, "new", "left_semi").select("new", F.lit(True).alias("_held"))
    live = renames.select(F.col("old").alias("new")).join(keys, "new", "left_semi")
    steps = renames.join(held, "new", "left").join(live.withColumn("_on", F.lit(True)), "new", "left")
    verdict = F.when(F.col("_on").isNull(), F.col("_held").isNotNull())
    steps = checkpoint(steps.select("old", F.col("new").alias("_to"), verdict.alias("_stays")))
    open_ = lambda df: df.filter("_stays IS NULL")
    left, before = open_(steps).count(), None
    while left and left != before:
        ahead = steps.select(F.col("old").alias("_to"), F.col("_to").alias("_next"), F.col("_stays").alias("_then"))
        moved = open_(steps).join(ahead, "_to").select("old", F.col("_next").alias("_to"), F.col("_then").alias("_stays"))
        steps = checkpoint(steps.filter("_stays IS NOT NULL").union(moved))
        left, before = open_(steps).count(), left
    return steps.filter("_stays").select("old")


def rename_keys(source: Source, table: str, renames: DataFrame) -> dict[str, DataFrame]:
    """Replace keys (``old`` -> ``new``) of ``table`` and of the references to them.

    A key referenced through a column that does not follow updates is kept and
    reported under ``bloqueados``, and so is one whose new key would not be unique: asked for
    twice, or held by a row that keeps it. Keys can be swapped; a chain of renames
    of which one link is blocked is blocked down to its start.
    """
    key = TABLES[table].key
    asked, renames = renames.select("old").distinct(), renames.filter("old <> new").distinct()
    twice = _union(
        [
            renames.groupBy(c).count().filter("count > 1").select(F.col(c).alias("k"))
            .join(renames, F.col("k") == F.col(c)).select("old")
            for c in ("old", "new")
        ]
    ).distinct()
    keys = source(table).select(F.col(key).alias("new"))
    held = [
        source(child.name).select(F.col(c.name).alias("old")).filter("old IS NOT NULL").distinct()
        for child, c in children_of(table)
        if not c.update_cascades
    ]
    blocked = twice
    if held:
        blocked = blocked.union(asked.join(_union(held), "old", "left_semi")).distinct()
    blocked = checkpoint(blocked)
    moving = renames.join(blocked, "old", "left_anti")
    blocked = checkpoint(blocked.union(_blocked_down(moving, keys)))
    renames = moving.join(blocked, "old", "left_anti")
    out = {"bloqueados": blocked.select(F.col("old").alias(key))}
    columns: dict[str, list[str]] = {table: [key]}
    for child, c in children_of(table):
        if c.update_cascades:
            columns.setdefault(child.name, []).append(c.name)
    for name, names in columns.items():
        df = source(name)
        for column in names:
            df = (
                df.join(renames, F.col(column) == F.col("old"), "left")
                .withColumn(column, F.coalesce("new", column))
                .drop("old", "new")
            )
        out[name] = df
    return out
