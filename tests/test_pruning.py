import datetime as dt
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.operators.pruning import RANGES, key_ranges
from espalier.plans.star import ORDERS
from espalier.sources.append import _report_new, append_checked
from espalier.sources.ingest import scan
from espalier.sources.layout import write_declared
from espalier.operators.constraints import UniqueRule
from espalier.spec import Column, TableSpec
from tests.conftest import rows


def test_ranges_hold_every_key_and_skip_the_gap(spark):
    keys = spark.createDataFrame([(i,) for i in [*range(0, 50, 7), *range(10**9, 10**9 + 50)]] + [(None,)], "k long")
    found = key_ranges(keys, ["k"])
    [ranges] = found.columns
    assert len(ranges) <= RANGES + 1 and all(low <= high for low, high in ranges)
    there = spark.range(0, 1_000).unionByName(spark.range(10**9 - 1_000, 10**9 + 1_000)).withColumnRenamed("id", "key")
    kept = {r.key for r in found.prune(there, ["key"]).collect()}
    assert {r.k for r in keys.collect() if r.k is not None} <= kept and len(kept) < 200


@pytest.mark.parametrize("kind, values", [
    (T.DateType(), [dt.date(1900, 1, 1), dt.date(2020, 5, 5), dt.date(2020, 5, 6)]),
    (T.TimestampType(), [dt.datetime(1970, 1, 1, 0, 0, 0, 1), dt.datetime(2024, 2, 29, 23, 59, 59, 999_999)]),
    (T.DecimalType(38, 10), [Decimal("-12345678901234567890.5"), Decimal("0"), Decimal("12345678901234567890.0000000001")]),
    (T.LongType(), [-(2**63), 2**63 - 1, 0]), (T.StringType(), ["", "b", "é"]), (T.ByteType(), [-128, 127]),
    (T.DoubleType(), [float("nan"), 1.0]), (T.BooleanType(), [True]), (T.LongType(), [7, 7]), (T.LongType(), []),
])
def test_every_kind_of_key_is_kept(spark, kind, values):
    keys = spark.createDataFrame([(v,) for v in values] + [(None,)], T.StructType([T.StructField("k", kind)]))
    found = key_ranges(keys, ["k"])
    assert (found.columns[0] is None) == isinstance(kind, (T.DoubleType, T.BooleanType))
    assert found.prune(keys.filter("k is not null"), ["k"]).count() == len(values)


def test_keys_of_several_columns(spark):
    keys = spark.createDataFrame([(1, "a", 0.5), (None, "zz", 1.0), (5, "c", float("nan"))], "a long, b string, c double")
    found = key_ranges(keys, ["a", "b", "c"])
    assert found.columns[2] is None and found.columns[1] == [("a", "c")]
    table = spark.createDataFrame([(1, "b", 9.0), (5, "d", 9.0), (3, "b", 9.0), (None, "b", 9.0)], "x long, y string, z double")
    assert rows(found.prune(table, ["x", "y", "z"])) == [(1, "b", 9.0)]
    assert key_ranges(keys.select("c"), ["c"]).of(["z"]) is None


SPEC = replace(ORDERS, name="o", sort_by=("o_orderkey",), foreign_keys=())


def test_an_append_reads_only_its_ranges(spark, folder):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    path = folder + "/o"
    write_declared(orders.filter("o_orderkey % 2 = 0"), SPEC, path, partitions=8)
    stored, batch = scan(spark, path, SPEC), orders.filter("o_orderkey between 101 and 140 and o_orderkey % 2 = 1")
    report = _report_new(batch, stored, UniqueRule(("o_orderkey",), required=True), "o")
    plan = report._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(o_orderkey,101)" in plan
    read = key_ranges(batch, ["o_orderkey"]).prune(stored, ["o_orderkey"])
    assert read.select(F.input_file_name()).distinct().count() < 3 < len(stored.inputFiles())
    assert append_checked(batch, SPEC, path).committed
    assert not append_checked(batch, SPEC, path).committed
    assert scan(spark, path, SPEC).count() == orders.filter("o_orderkey % 2 = 0").count() + batch.count()


def test_declared_layout_has_folders_and_order(spark, folder):
    spec = TableSpec("t", (Column("k", T.LongType()), Column("p", T.StringType())), primary_key=("k",), partition_by=("p",), sort_by=("k",))
    batch = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "k long, p string")
    assert append_checked(batch.filter("k < 10"), spec, folder + "/t").committed
    assert append_checked(batch.filter("k >= 10"), spec, folder + "/t").committed
    assert rows(scan(spark, folder + "/t", spec)) == rows(batch)
    assert rows(spark.read.parquet(folder + "/t/p=a").select("k")) == sorted([(i,) for i in range(0, 20, 2)], key=repr)
