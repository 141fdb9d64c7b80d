"""Laying a table out so that later lookups skip most of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.functions.rowhash import row_hash
from espalier.spec import TableSpec, names

_Z = "__z"


def clustered(
    df: DataFrame, sort_by: str | Iterable[str], partition_by: str | Iterable[str] = (), partitions: int | None = None
) -> DataFrame:
    """The rows dealt out by ranges and sorted within them.

    The range exchange takes both column lists together, and a hash of the row
    after them, so a value that holds a large share of the rows is cut into
    several files, and each file covers a narrow range that parquet's min/max
    statistics can skip. It reads `df` twice: a sample comes first.
    """
    ranged = [F.col(f"`{c}`").asc_nulls_last() for c in (*names(partition_by), *names(sort_by))]
    ends = [*ranged, row_hash(df)]
    split = df.repartitionByRange(partitions, *ends) if partitions else df.repartitionByRange(*ends)
    return split.sortWithinPartitions(*ranged)


def _save(df: DataFrame, path: str, partition_by: tuple[str, ...], mode: str) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_clustered(
    df: DataFrame,
    path: str,
    sort_by: str | Iterable[str],
    partition_by: str | Iterable[str] = (),
    partitions: int | None = None,
) -> None:
    """Folders by `partition_by`, files in `sort_by` order."""
    _save(clustered(df, sort_by, partition_by, partitions), path, names(partition_by), "overwrite")


def write_declared(
    df: DataFrame,
    spec: TableSpec,
    path: str,
    mode: str = "overwrite",
    partitions: int | None = None,
    watch: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """Write rows in the layout that `spec` declares; without one, as they lie.

    `watch` is put in where rows are in place, right before they are written."""
    if spec.z_by:
        df = z_ordered(df, spec.z_by, partitions=partitions)
    elif spec.sort_by or spec.partition_by:
        df = clustered(df, spec.sort_by, spec.partition_by, partitions)
    _save(watch(df), path, spec.partition_by, mode)


# --- several columns at once -----------------------------------------------------


def z_order(df: DataFrame, columns: Sequence[str], bits: int = 8) -> Column:
    """A number that orders rows along all `columns` at once: the interleaved bits
    of the places of their values.

    A value's place is how many of `2 ** bits - 1` cut points lie below it; cut
    points are approximate quantiles of each column, all from one scan, so that
    uneven columns are cut evenly. Texts are cut by their first six bytes. NULL
    comes first.
    """
    if len(columns) * bits > 62:
        raise ValueError("too many bits for one number")
    kinds = {f.name: f.dataType for f in df.schema}
    numbers = [_number(F.col(f"`{c}`"), kinds[c]) for c in columns]
    shares = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    cuts = df.agg(*[F.percentile_approx(n, shares, F.lit(100 << bits)).alias(f"c{i}") for i, n in enumerate(numbers)]).first()
    z = F.lit(0).cast("long")
    for i, number in enumerate(numbers):
        points = F.array(*[F.lit(x) for x in sorted(cuts[i] or ())]).cast("array<double>")
        place = F.when(number.isNull(), F.lit(0)).otherwise(F.size(F.filter(points, lambda p: p < number))).cast("long")
        for b in range(bits):
            bit = F.shiftright(place, b).bitwiseAND(F.lit(1))
            z = z.bitwiseOR(F.shiftleft(bit, b * len(columns) + i))
    return z


def _number(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        padded = F.rpad(F.substring(value.cast("binary"), 1, 6), 6, F.lit(bytearray(1)))
        return F.conv(F.hex(padded), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return value.cast("double")


def z_ordered(df: DataFrame, columns: Sequence[str], bits: int = 8, partitions: int | None = None) -> DataFrame:
    """The rows dealt out by ranges of their `z_order` and sorted within them.

    Cut points are those of `df`: files of a later batch are narrow in each
    column as well, by the batch's own."""
    ordered = df.withColumn(_Z, z_order(df, columns, bits))
    ends = [F.col(_Z), row_hash(df)]
    split = ordered.repartitionByRange(partitions, *ends) if partitions else ordered.repartitionByRange(*ends)
    return split.sortWithinPartitions(_Z).drop(_Z)


def write_z_ordered(df: DataFrame, path: str, columns: Sequence[str], bits: int = 8, partitions: int | None = None) -> None:
    """Files that are narrow in each of `columns`, so that a lookup by any of them skips most files.

    `write_clustered` serves its first column best and the others hardly at all;
    here each of k columns skips about as if there were n ** (1 / k) files.
    """
    _save(z_ordered(df, columns, bits, partitions), path, (), "overwrite")


def write_bucketed(df: DataFrame, name: str, path: str, by: str | Iterable[str], buckets: int) -> DataFrame:
    """Save `df` as the table `name`, hashed and sorted by a key into buckets.

    Parent and child saved with the same number of buckets on the linking key
    join without an exchange, however often. For evenly used keys only: a
    bucket can't be split, so a key with a large share of the rows belongs in
    `write_clustered`.
    """
    keys = names(by)
    hashed = df.repartition(buckets, *keys)
    writer = hashed.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def write_subset(df: DataFrame, predicate: Column, path: str) -> None:
    """Keep the rows that satisfy `predicate` as a table of their own."""
    df.filter(predicate).write.mode("overwrite").parquet(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows out to `partitions` tasks.

    For work that is heavy on CPU per row over a table kept in few files; it
    costs an exchange of all rows. Without a number the table stays as it is.
    """
    return df if partitions is None else df.repartition(partitions)
