"""Row policies: which rows of a table a reader may see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_policy(df: DataFrame, *policies: Column | bool) -> DataFrame:
    """Rows that at least one policy admits; without a policy, none.

    A policy of TRUE is folded away by the optimizer, and no policy at all
    folds to an empty relation, so neither costs a scan.
    """
    admitted = [F.lit(p) if isinstance(p, bool) else p for p in policies]
    return df.filter(reduce(lambda a, b: a | b, admitted, F.lit(False)))
