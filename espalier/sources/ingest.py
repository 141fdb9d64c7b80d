"""Reading tables under a declared schema, and shaping new rows to it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.functions.timeutil import load_instant
from espalier.functions.types import fits_type, fits_varchar, to_type, to_varchar
from espalier.spec import ABSENT, Column, TableSpec


def scan(spark: SparkSession, path: str, schema: T.StructType | TableSpec) -> DataFrame:
    """Parquet under a declared schema; nothing is inferred."""
    struct = schema.schema if isinstance(schema, TableSpec) else schema
    return spark.read.schema(struct).parquet(path)


def literal_rows(
    spark: SparkSession, rows: Sequence[tuple], spec: TableSpec, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows written out in a program, for the listed columns of `spec`."""
    listed = columns or [c.name for c in spec.columns]
    return spark.createDataFrame(
        rows, T.StructType([T.StructField(n, spec.column(n).type) for n in listed])
    )


def conform(
    df: DataFrame,
    spec: TableSpec,
    as_of: dt.datetime | None = None,
    lenient: bool = False,
    besides: Mapping[str, SparkColumn] | None = None,
) -> DataFrame:
    """`df` with exactly the columns of `spec`, in its order and types.

    A default fills a column that `df` lacks; a NULL that `df` holds stays
    NULL. Generated keys that `df` lacks are left out, for `assign_keys`. A value
    that doesn't fit stops the job; `lenient` lets it become NULL, for callers
    that count such values on the way and throw the rows away. `besides` are
    further columns, over those of `df`.
    """
    known = {c.name for c in spec.columns}
    unknown = [c for c in df.columns if c not in known]
    if unknown:
        raise ValueError(f"{spec.name} has no column {', '.join(unknown)}")
    now = load_instant(as_of)
    chosen = []
    for column in spec.columns:
        if column.name in df.columns:
            chosen.append(_cast(df, column, lenient).alias(column.name))
        elif not column.generated:
            chosen.append(_default(column, now).cast(column.type).alias(column.name))
    return df.select(*chosen, *[c.alias(name) for name, c in (besides or {}).items()])


def _cast(df: DataFrame, column: Column, lenient: bool) -> SparkColumn:
    value = F.col(f"`{column.name}`")
    kind = df.schema[column.name].dataType
    if kind != column.type:
        if isinstance(kind, T.FractionalType) and isinstance(column.type, T.IntegralType):
            value = F.round(value)  # half up, as for decimals; the range is judged after it
        value = F.when(fits_type(value, column.type), value.try_cast(column.type)) if lenient else to_type(value, column.type)
    if column.max_length is None:
        return value
    fitting = F.when(fits_varchar(value, column.max_length), value) if lenient else value
    return to_varchar(fitting, column.max_length)


def _default(column: Column, now: SparkColumn) -> SparkColumn:
    if column.default is ABSENT:
        return F.lit(None)
    return column.default(now) if callable(column.default) else F.lit(column.default)


def append_rows(df: DataFrame, spec: TableSpec, path: str, as_of: dt.datetime | None = None) -> None:
    """Conform `df` and add it to the table at `path`. Generated keys have to be there."""
    missing = [c.name for c in spec.columns if c.generated and c.name not in df.columns]
    if missing:
        raise ValueError(f"{spec.name}: no {', '.join(missing)}; assign_keys numbers rows, last_key says where to start")
    conform(df, spec, as_of).write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Replace the table at `path`; running it again gives the same content."""
    df.write.mode("overwrite").parquet(path)


def register(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Give a query a name that SQL can use."""
    df.createOrReplaceTempView(name)
    return spark.table(name)
