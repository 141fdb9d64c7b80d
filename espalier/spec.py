"""Declared schemas: columns, domains, keys and rules as plain values."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Absent:
    """Marks a column without a default (None is a legal default)."""

    def __repr__(self) -> str:
        return "ABSENT"


ABSENT = _Absent()


@dataclass(frozen=True)
class Domain:
    """A closed, ordered set of strings; rank is the position in `values`."""

    name: str
    values: tuple[str, ...]

    def contains(self, col: SparkColumn) -> SparkColumn:
        return col.isin(*self.values)

    def rank(self, col: SparkColumn) -> SparkColumn:
        """1-based rank in declaration order; NULL for anything outside."""
        position = F.array_position(F.array(*[F.lit(v) for v in self.values]), col)
        return F.nullif(position, F.lit(0)).cast("int")


@dataclass(frozen=True)
class Column:
    """One declared column.

    `default` is a literal, or a function that takes the load instant (a
    Column) and returns a Column. `generated` marks a surrogate key that
    `assign_keys` fills. `collation` gives a text column an order of its own, by
    one of Spark's names (`UTF8_LCASE`, `UNICODE_CI`, `de_AI` …): sorting,
    grouping, keys and joins of the declared table then follow it. Without one,
    texts are ordered and compared by their bytes.
    """

    name: str
    type: T.DataType
    required: bool = False
    default: object = ABSENT
    max_length: int | None = None
    domain: Domain | None = None
    generated: bool = False
    collation: str | None = None

    def __post_init__(self) -> None:
        if self.collation is not None:
            if not isinstance(self.type, T.StringType):
                raise ValueError(f"{self.name} is no text, so it has no collation")
            object.__setattr__(self, "type", T.StringType(self.collation))


@dataclass(frozen=True)
class Check:
    """A named row rule; a row breaks it only where the condition is FALSE."""

    name: str
    condition: Callable[[], SparkColumn]


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSpec:
    """A declared table. `partition_by` and `sort_by` are its layout: folders,
    and the order of rows over and within files. `z_by`, in their place, orders
    rows by several columns at once, for lookups by any of them."""

    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[Check, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = field(default=())
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    z_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.z_by and (self.sort_by or self.partition_by):
            raise ValueError(f"{self.name} declares two layouts")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type) for c in self.columns])

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


def names(columns: str | Iterable[str]) -> tuple[str, ...]:
    """One name or several, as a tuple."""
    return (columns,) if isinstance(columns, str) else tuple(columns)
