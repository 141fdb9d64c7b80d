"""Equality lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows equal to `wanted` in all its columns; a NULL equals nothing."""
    tests = [F.col(f"`{name}`") == F.lit(value) for name, value in wanted.items()]
    return df.filter(reduce(lambda a, b: a & b, tests))
