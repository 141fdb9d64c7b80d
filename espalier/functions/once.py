"""Costly expressions, evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with `columns` added, as `withColumns` would.

    A plain added column is copied into every filter and projection above that
    uses it, and evaluated there again. A generated column isn't.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
