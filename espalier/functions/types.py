"""Casts with a database's insert rules, as built-in expressions.

The `to_*` forms stop the job on a bad value, with or without ANSI mode. The
`fits_*` forms say whether a value would pass; NULL always does.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fits_varchar(col: Column, n: int) -> Column:
    """Excess characters are allowed only where they are trailing spaces."""
    return F.length(F.rtrim(col)) <= n


def to_varchar(col: Column, n: int) -> Column:
    problem = F.concat(F.lit(f"value too long for {n} characters: "), col)
    return (
        F.when(col.isNull() | (F.length(col) <= n), col)
        .when(fits_varchar(col, n), F.substring(col, 1, n))
        .otherwise(F.raise_error(problem).cast("string"))
    )


# The widest decimal there is.
_WIDEST = 38


def fits_type(col: Column, target: T.DataType) -> Column:
    if isinstance(target, T.DecimalType) and target.precision < _WIDEST:
        # Comparing a wide decimal is far cheaper than catching an overflow
        # per bad value.
        wide = col.try_cast(T.DecimalType(_WIDEST, target.scale))
        bound = F.lit(Decimal(10) ** (target.precision - target.scale))
        return col.isNull() | F.coalesce(F.abs(wide) < bound, F.lit(False))
    return col.isNull() | col.try_cast(target).isNotNull()


def to_type(col: Column, target: T.DataType) -> Column:
    problem = F.concat(F.lit(f"not a {target.simpleString()}: "), col.cast("string"))
    return F.when(fits_type(col, target), col.try_cast(target)).otherwise(
        F.raise_error(problem).cast(target)
    )


def fits_numeric(col: Column, precision: int, scale: int) -> Column:
    """Judged after rounding half up, so 99.95 doesn't fit (3, 1)."""
    return fits_type(col, T.DecimalType(precision, scale))


def to_numeric(col: Column, precision: int, scale: int) -> Column:
    return to_type(col, T.DecimalType(precision, scale))
