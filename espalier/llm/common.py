"""What several of the operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from espalier.durable import materialize

# The six white-space characters of the contracts, as a regex
# class and as a plain string.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows per Arrow batch: a row here is a whole document or a tile,
    so the default of 10,000 would put far too much into one Python worker."""
    spark.conf.set(_BATCH, str(rows))


def q(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col(f"`{name}`")


def unused(df: DataFrame, *wanted: str) -> tuple[str, ...]:
    """Names for helper columns that no column of `df` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return tuple(out)


def text_of(name: str) -> Column:
    return F.coalesce(q(name).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells the rows of a table of documents apart.

    Two hashes, never null. Rows that agree in both are copies of one row and
    have equal results, so repeated rows and ids that are null or not unique
    need no care elsewhere.
    """
    return [F.xxhash64(q(id_col)).alias("key_id"), F.xxhash64(text_of(text_col)).alias("key_text")]


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def nulls_last(*columns: Column) -> list[Column]:
    return [c.asc_nulls_last() for c in columns]


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """`(node, root)` for every node of `edges (a, b)`; root is the least node reachable.

    Alternating star contraction: each node hangs its larger neighbours on the
    least one it knows, then itself and its smaller ones. Both steps keep the
    components, and the edge set shrinks to one star per component within a
    logarithmic number of rounds, long chains included. Every round is stored,
    so lineage stays short; the least neighbour is a grouped minimum that is
    combined before the exchange, and the join back to it is one that adaptive
    execution splits at a hot node. Only a count and a checksum reach the driver.
    """
    now = materialize(_directed(edges), label)
    state = _checksum(now)
    while True:
        large = _star(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), only_larger=True)
        large = materialize(large, label)
        now = materialize(_star(_directed(large), only_larger=False), label)
        was, state = state, _checksum(now)
        if was == state:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, only_larger: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = edges.join(least, "a")
    if only_larger:
        return hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    own = least.select("a", F.col("m").alias("b"))
    others = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(others).filter("a <> b").distinct()


def _checksum(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    # Two halves, so that the sums can't overflow.
    row = edges.agg(
        F.count(F.lit(1)),
        F.sum(mixed.bitwiseAND(F.lit(0x7FFFFFFF))),
        F.sum(F.shiftrightunsigned(mixed, 33)),
    ).first()
    return tuple(row)

