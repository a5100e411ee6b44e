"""Building blocks for declaring the tables of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

RESTRICT, CASCADE, SET_NULL = "RESTRICT", "CASCADE", "SET NULL"

# Defaults that are not literals: the job's business date and run timestamp.
AS_OF, RUN_TS = object(), object()


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    nullable: bool = False
    size: int | None = None
    domain: tuple[str, ...] | None = None
    default: object = None
    parent: str | None = None
    on_delete: str | None = None
    update_cascades: bool = True


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    generated: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return self.columns[0].name

    @property
    def references(self) -> list[Column]:
        return [c for c in self.columns if c.parent]

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable) for c in self.columns])


def integer(name, null=False, default=None):
    return Column(name, T.IntegerType(), null, default=default)


def key(name, type=None):
    return Column(name, type or T.LongType())


def text(name, size=None, null=False):
    return Column(name, T.StringType(), null, size=size)


def choice(name, domain, default=None, null=False):
    return Column(name, T.StringType(), null, domain=tuple(domain), default=default)


def flag(name, default):
    return Column(name, T.BooleanType(), default=default)


def amount(name, precision, scale, null=False, default=None):
    return Column(name, T.DecimalType(precision, scale), null, default=default)


def day(name, null=False, default=None):
    return Column(name, T.DateType(), null, default=default)


def moment(name, null=False, default=None):
    return Column(name, T.TimestampNTZType(), null, default=default)


def stamp(name, null=False):
    return Column(name, T.TimestampType(), null, default=RUN_TS)


def clock(name):
    return Column(name, T.StringType(), True)


def ref(name, parent, on_delete, null=False, type=None, update_cascades=True):
    return Column(
        name,
        type or T.IntegerType(),
        null,
        parent=parent,
        on_delete=on_delete,
        update_cascades=update_cascades,
    )


def big(name, null=True):
    return Column(name, T.LongType(), null)
