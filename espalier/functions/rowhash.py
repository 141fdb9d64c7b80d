"""A tie-breaker that depends on nothing but the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_hash(df: DataFrame) -> Column:
    """Spreads rows that agree in a sort key over several ranges. A task that
    runs again gives the same value, so no row changes its range."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not _has_map(f.dataType)])


def _has_map(kind: T.DataType) -> bool:
    """Maps can't be hashed, wherever they lie."""
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType)
