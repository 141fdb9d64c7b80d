"""Exact distinct counts that merge, as bitmaps over dense whole-number keys.

A bitmap holds the keys of one stretch of 32,768 that a group has seen. Bitmaps of
a coarser group are those of its parts, or-ed together, so a key that lies in
several parts counts once, and no row is read or copied again for a further
level or a further count. A key takes a bit, and a group 4 kB for each stretch
it touches: for groups that are few against their keys, and keys that are dense,
such as those of `assign_keys`. Sets of very many small groups are better
counted below the joins, as `Hierarchy.summary` does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from espalier.durable import materialize

_STRETCH = "__stretch"


def distinct_bitmaps(df: DataFrame, by: Sequence[str], key: Column, counts: Mapping[str, Column | None]) -> DataFrame:
    """`by…, stretch` with one bitmap per entry of `counts`: of the keys where its
    condition is TRUE, or of all keys for None. A NULL key counts nowhere.

    All conditions share one grouping, combined before the exchange."""
    at = F.bitmap_bit_position(key)
    maps = [F.bitmap_construct_agg(at if c is None else F.when(c, at)).alias(name) for name, c in counts.items()]
    return df.filter(key.isNotNull()).groupBy(*by, F.bitmap_bucket_number(key).alias(_STRETCH)).agg(*maps)


def merged(maps: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """The bitmaps of the coarser groups `by`."""
    return maps.groupBy(*by, _STRETCH).agg(*[F.bitmap_or_agg(c).alias(c) for c in counts])


def counted(maps: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """`by…` with the number of distinct keys of each bitmap; groups whose bitmaps are empty have zeros."""
    return maps.groupBy(*by).agg(*[F.coalesce(F.sum(F.bitmap_count(c)), F.lit(0)).cast("long").alias(c) for c in counts])


def distinct_rollup(
    df: DataFrame, levels: Sequence[Sequence[str]], key: Column, counts: Mapping[str, Column | None], label: str = "bitmaps"
) -> DataFrame:
    """Distinct counts for every one of `levels`, finest first, each a part of the one before.

    `df` is read once, for the finest level, whose bitmaps are stored; each
    coarser level is merged from the one before. Columns that a level doesn't
    group by are NULL in its rows, and `level` numbers the levels from 0.
    """
    for fine, coarse in zip(levels, levels[1:]):
        if not set(coarse) <= set(fine):
            raise ValueError(f"{', '.join(coarse)} can't be merged from {', '.join(fine)}")
    names, maps, parts = list(counts), None, []
    for i, by in enumerate(levels):
        made = distinct_bitmaps(df, by, key, counts) if maps is None else merged(maps, by, names)
        maps = materialize(made, label)
        kept = [F.col(f"`{c}`") if c in by else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in levels[0]]
        parts.append(counted(maps, by, names).select(F.lit(i).alias("level"), *kept, *names))
    return reduce(DataFrame.unionByName, parts)
