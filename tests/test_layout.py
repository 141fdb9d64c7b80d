import datetime as dt
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.operators.constraints import check_foreign_key, check_unique
from espalier.operators.keys import assign_keys
from espalier.operators.lookup import lookup
from espalier.sources.ingest import conform, scan
from espalier.sources.layout import write_clustered, write_z_ordered, z_order
from espalier.spec import Column, TableSpec
from tests.conftest import rows


def _files_that_may_hold(path, column, value):
    import glob

    n = 0
    for file in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.to_arrow_schema().get_field_index(column)
        stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        n += any(s.min <= value <= s.max for s in stats)
    return n


def test_either_column_alone_skips_files(spark, folder):
    dice = random.Random(1)
    data = [(i, dice.randint(0, 999), int(dice.paretovariate(0.5)) % 100_000) for i in range(20_000)]
    df = spark.createDataFrame(data, "id long, a long, b long")
    write_z_ordered(df, folder + "/z", ["a", "b"], partitions=64)
    write_clustered(df, folder + "/c", ["a", "b"], partitions=64)
    stored = spark.read.parquet(folder + "/z")
    assert rows(stored) == rows(df)
    for value in (500, 7):
        assert rows(lookup(stored, {"a": value})) == rows(df.filter(F.col("a") == value))
    some = {k: dice.sample(sorted({r[k] for r in data}), 30) for k in (1, 2)}
    by = {(where, c): sum(_files_that_may_hold(f"{folder}/{where}", c, v) for v in some[k]) / 30 for where in "zc" for k, c in ((1, "a"), (2, "b"))}
    assert by["z", "a"] <= 16 and by["z", "b"] <= 24 and by["c", "b"] >= 40, by


@pytest.mark.parametrize("kind, low, high", [
    (T.StringType(), "abc", "abd"), (T.StringType(), "a", "a\x01\x02"), (T.DateType(), dt.date(1969, 1, 1), dt.date(2020, 1, 1)),
    (T.TimestampType(), dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)), (T.DoubleType(), -1.5, 2.5), (T.DecimalType(10, 2), 1, 2),
])
def test_every_kind_has_an_order(spark, kind, low, high):
    from decimal import Decimal

    low, high = (Decimal(v) if isinstance(kind, T.DecimalType) else v for v in (low, high))
    df = spark.createDataFrame([(v, 0) for v in (low, high, None, low)], T.StructType([T.StructField("v", kind), T.StructField("w", T.IntegerType())]))
    got = {r.v: r.z for r in df.select("v", z_order(df, ["v", "w"]).alias("z")).collect()}
    assert got[None] <= got[low] <= got[high] and got[None] == 0


def test_no_rows_and_too_many_bits(spark, folder):
    empty = spark.createDataFrame([], "a long, b string")
    write_z_ordered(empty, folder + "/e", ["a", "b"])
    assert spark.read.schema(empty.schema).parquet(folder + "/e").count() == 0
    with pytest.raises(ValueError):
        z_order(empty, ["a", "b"], bits=40)


# --- collations ----------------------------------------------------------

NAMES = TableSpec("names", (Column("id", T.LongType()), Column("name", T.StringType(), collation="UTF8_LCASE", max_length=9)), unique=(("name",),))


def test_a_collation_is_honoured_by_order_keys_and_joins(spark, folder):
    given = spark.createDataFrame([(1, "b"), (2, "A"), (3, "a"), (4, "B "), (5, "C"), (6, None)], "id long, name string")
    conform(given, NAMES).write.parquet(folder + "/n")
    names = scan(spark, folder + "/n", NAMES)
    assert names.schema["name"].dataType == T.StringType("UTF8_LCASE")
    assert [r.id for r in names.orderBy(F.col("name").asc_nulls_last(), "id").collect()] == [2, 3, 1, 4, 5, 6]
    assert check_unique(names, ["name"]).first()["n_violations"] == 2
    assert check_unique(given, ["name"]).first()["n_violations"] == 0
    loud = spark.createDataFrame([("B",), ("c",)], "up string").select(F.col("up").cast(T.StringType("UTF8_LCASE")).alias("up"))
    assert check_foreign_key(names, ["name"], loud, ["up"]).first()["n_violations"] == 3
    assert rows(lookup(names, {"name": "a"}), "id") == [(2,), (3,)]
    ranked = assign_keys(names, ["name", "id"], key="place")
    assert [r.id for r in ranked.orderBy("place").collect()] == [2, 3, 1, 4, 5, 6]


def test_only_texts_have_a_collation():
    with pytest.raises(ValueError):
        Column("id", T.LongType(), collation="UTF8_LCASE")


def test_a_table_may_declare_an_order_by_several_columns(spark, folder):
    from espalier.sources.append import append_checked
    from espalier.sources.publish import publish, read_published

    spec = TableSpec("t", (Column("a", T.LongType(), required=True), Column("b", T.LongType())), primary_key=("a",), z_by=("a", "b"))
    df = spark.range(500).select(F.col("id").alias("a"), (F.col("id") * 7 % 100).alias("b"))
    assert append_checked(df.filter("a < 300"), spec, folder + "/t").committed
    assert append_checked(df.filter("a >= 300"), spec, folder + "/t").committed
    assert not append_checked(df.filter("a = 7"), spec, folder + "/t").committed
    assert rows(scan(spark, folder + "/t", spec)) == rows(df)
    done = publish(spark, {"t": df.unionByName(spark.createDataFrame([(None, 1)], "a long, b long"))}, [spec], folder + "/p")
    assert not done.committed and {(r.constraint, r.kind): r.n_violations for r in done.audit.collect()} == {("a", "not_null"): 1, ("a", "primary_key"): 1}
    assert publish(spark, {"t": df}, [spec], folder + "/p").committed
    assert rows(read_published(spark, folder + "/p", spec)) == rows(df)
    with pytest.raises(ValueError):
        TableSpec("t", spec.columns, z_by=("a", "b"), sort_by=("a",))
