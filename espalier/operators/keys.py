"""Dense surrogate keys, numbered in parallel."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.durable import materialize
from espalier.functions.rowhash import row_hash
from espalier.spec import names

_TIE = "__tie"
_SLOT = "__slot"
_CHUNK = "__chunk"
_BEFORE = "__before"
# monotonically_increasing_id() keeps the partition above bit 33 and the
# position within it below (documented layout).
_POSITION_BITS = 33
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def assign_keys(
    df: DataFrame,
    order_by: str | Iterable[str],
    start: int = 0,
    key: str = "id",
    partitions: int | None = None,
) -> DataFrame:
    """`df` with ids `start + 1, start + 2, …` in `order_by` order, no gaps.

    Rows are range-partitioned on all of `order_by`, sorted, and stored in the
    shared folder with their place; the stored copy makes the second pass see
    the very rows the first one counted. Only one row count per partition
    reaches the driver. Rows that `order_by` doesn't tell apart are ordered by a
    hash of the whole row, which keeps ids repeatable and lets one value with
    many rows take several ranges.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.col(f"`{c}`").asc_nulls_last() for c in names(order_by)], F.col(_TIE)]
    placed = materialize(
        df.withColumn(_TIE, row_hash(df))
        .repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
        .drop(_TIE)
        .withColumn(_SLOT, F.monotonically_increasing_id()),
        "keys",
    ).withColumn(_CHUNK, F.shiftright(_SLOT, _POSITION_BITS))

    sizes = sorted((r[_CHUNK], r["count"]) for r in placed.groupBy(_CHUNK).count().collect())
    before = accumulate((n for _, n in sizes), initial=start)
    offsets = spark.createDataFrame(
        [(chunk, offset) for (chunk, _), offset in zip(sizes, before)],
        T.StructType([T.StructField(_CHUNK, T.LongType()), T.StructField(_BEFORE, T.LongType())]),
    )
    # At most one row per partition, so this side is bounded by `count`.
    numbered = placed.join(F.broadcast(offsets), _CHUNK)
    position = F.col(_SLOT).bitwiseAND(F.lit(_POSITION_MASK))
    return numbered.select((F.col(_BEFORE) + position + 1).alias(key), *[f"`{c}`" for c in df.columns])


def last_key(df: DataFrame, key: str = "id") -> int:
    """The highest id in use, 0 for an empty table; new ids start after it."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).first()[0]
