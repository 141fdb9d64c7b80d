"""Reading only the part of a large table that can hold some given keys.

The keys at hand are reduced to a bounded number of ranges, and the ranges become
a filter that reaches the scan: files and row groups whose statistics lie outside
aren't read. With a table clustered by the key, the cost of meeting a batch
follows the batch, not the table. Where the table isn't clustered the filter
still drops rows before any exchange. Rows outside the ranges equal no key at
hand, so a join with the keys loses nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# At most so many ranges of one column.
RANGES = 64
_ORDERED = (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
_SPACED = (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType)


@dataclass(frozen=True)
class KeyRanges:
    """Ranges `(lowest, highest)` of each key column, None for a column that can't be pruned by."""

    columns: tuple[list[tuple] | None, ...]

    def of(self, columns: Sequence[str]) -> Column | None:
        """The filter on `columns` of another table; None where nothing can be pruned."""
        parts = []
        for name, ranges in zip(columns, self.columns, strict=True):
            if ranges is not None:
                within = [F.col(f"`{name}`").between(F.lit(low), F.lit(high)) for low, high in ranges]
                parts.append(reduce(lambda a, b: a | b, within) if within else F.lit(False))
        return reduce(lambda a, b: a & b, parts) if parts else None

    def prune(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """The rows of `df` whose `columns` may equal one of the keys, and maybe others."""
        condition = self.of(columns)
        return df if condition is None else df.filter(condition)


def key_ranges(keys: DataFrame, columns: Sequence[str], most: int = RANGES) -> KeyRanges:
    """Where the keys lie: at most `most` ranges of each column, in two scans of `keys`.

    Between the least and the greatest value the line is cut into `most` equal
    parts, and each part that holds keys gives the range of those, so that keys
    that lie in several far places don't make one range of all between. Texts
    give a single range. A key with a NULL equals no other and plays no part; a
    column of floating-point numbers, or of another kind without an order that
    statistics keep, isn't pruned by.
    """
    whole = keys.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)])
    whole = whole.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in whole.columns]))
    kinds = [f.dataType for f in whole.schema]
    if not any(isinstance(k, _ORDERED) for k in kinds):
        return KeyRanges((None,) * len(kinds))
    ends = whole.agg(*[f(f"k{i}").alias(f"{f.__name__}{i}") for i in range(len(kinds)) for f in (F.min, F.max)]).first()
    found: list[list[tuple] | None] = []
    for i, kind in enumerate(kinds):
        low, high = ends[2 * i], ends[2 * i + 1]
        if not isinstance(kind, _ORDERED):
            found.append(None)
        elif low is None:
            found.append([])
        elif low == high or not isinstance(kind, _SPACED):
            found.append([(low, high)])
        else:
            found.append(_occupied(whole, f"k{i}", kind, low, high, most))
    return KeyRanges(tuple(found))


def _occupied(whole: DataFrame, key: str, kind: T.DataType, low: object, high: object, most: int) -> list[tuple]:
    def place(value: Column) -> Column:
        if isinstance(kind, T.DateType):
            return F.unix_date(value).cast("double")
        return (F.unix_micros(value) if isinstance(kind, T.TimestampType) else value).cast("double")

    first, last = place(F.lit(low).cast(kind)), place(F.lit(high).cast(kind))
    # Rounding may move a key to the next part: ranges are taken from the keys, so none is lost.
    part = F.floor((place(F.col(key)) - first) / (last - first) * most)
    rows = whole.groupBy(part.alias("part")).agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    return sorted((r["low"], r["high"]) for r in rows)  # most + 1 at the most
