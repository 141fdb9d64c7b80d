import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.functions.timeutil import load_instant, to_utc
from espalier.operators.constraints import validate_raw
from espalier.operators.keys import assign_keys, last_key
from espalier.operators.lookup import lookup
from espalier.operators.policy import apply_policy
from espalier.plans.catalog import catalog_specs
from espalier.sources.ingest import append_rows, conform, literal_rows, register, scan, write_table
from espalier.sources.layout import spread, write_bucketed, write_clustered, write_subset
from tests.conftest import rows

SPECS = catalog_specs("Example University")
AS_OF = dt.datetime(2024, 5, 6, 7, 8, 9)


def test_literal_rows_with_a_column_list(spark):
    df = literal_rows(spark, [("A", "a", "O'Reilly", "x")], SPECS["branches"],
                      ["id", "code", "name", "effective_session"])
    got = conform(df, SPECS["branches"], AS_OF).first().asDict()
    assert got["university"] == "Example University" and got["degree"] == "B.Tech"
    assert got["name"] == "O'Reilly" and got["created_at"] == AS_OF


def test_defaults_fill_absent_columns_only(spark):
    absent = literal_rows(spark, [(1, "t")], SPECS["topics"], ["unit_id", "topic_title"])
    got = conform(absent, SPECS["topics"], AS_OF).first()
    assert (got.is_high_yield, got.importance_level, got.exam_frequency) == (False, "MEDIUM", "OCCASIONAL")
    assert got.key_concepts is None and "id" not in got.asDict()
    explicit = literal_rows(spark, [(1, "t", None, [])], SPECS["topics"],
                            ["unit_id", "topic_title", "importance_level", "key_concepts"])
    got = conform(explicit, SPECS["topics"], AS_OF).first()
    assert got.importance_level is None and got.key_concepts == []


def test_conform_order_types_and_unknown_columns(spark):
    df = spark.createDataFrame([("1", "2", "B", "c", "t", "PCC", "THEORY", "2.25")],
                               ["id", "semester_id", "branch_id", "course_code", "course_title", "category",
                                "delivery_type", "credits"])
    got = conform(df, SPECS["courses"], AS_OF)
    assert got.columns == [c.name for c in SPECS["courses"].columns]
    row = got.first()
    assert (row.id, row.credits, row.exam_hours, row.total_marks) == (1, Decimal("2.3"), 3, 100)
    with pytest.raises(ValueError, match="no column zzz"):
        conform(df.withColumn("zzz", F.lit(1)), SPECS["courses"])


def test_validate_raw_names_values_that_would_not_load(spark):
    df = spark.createDataFrame([("x", "2.5"), ("7", "1000"), (None, None)], ["semester_id", "credits"])
    got = {r["constraint"]: r.n_violations for r in validate_raw(df, SPECS["courses"]).collect()}
    assert got == {"semester_id": 1, "credits": 1}


def test_append_continues_after_the_highest_id(spark, folder):
    path = folder + "/labs"
    spec = SPECS["lab_experiments"]
    given = literal_rows(spark, [(41, 1, 1, "a", "d", None)], spec)
    write_table(conform(given, spec), path)
    more = literal_rows(spark, [(1, 3, "c", "d"), (1, 2, "b", "d")], spec,
                        ["course_id", "experiment_number", "title", "description"])
    append_rows(assign_keys(more, "experiment_number", last_key(scan(spark, path, spec))), spec, path)
    assert rows(scan(spark, path, spec), "id", "title") == [(41, "a"), (42, "b"), (43, "c")]


def test_rebuild_is_repeatable(spark, folder):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    write_table(df, folder + "/t")
    once = rows(spark.read.parquet(folder + "/t"))
    write_table(df, folder + "/t")
    assert rows(spark.read.parquet(folder + "/t")) == once


def test_last_key_of_an_empty_table(spark):
    assert last_key(spark.createDataFrame([], "id long")) == 0


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_keys_are_dense_and_ordered(spark, partitions):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 3).alias("b"))
    got = assign_keys(df, ["b", "a"], start=100, partitions=partitions).collect()
    assert sorted(r.id for r in got) == list(range(101, 1101))
    assert [(r.b, r.a) for r in sorted(got, key=lambda r: r.id)] == sorted((r.b, r.a) for r in got)


def test_keys_with_one_value_on_a_third_of_the_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("hot"), "id")
    got = assign_keys(df, ["hot", "id"], key="k", partitions=8).collect()
    assert sorted(r.k for r in got) == list(range(1, 3001))
    assert [(r.hot, r.id) for r in sorted(got, key=lambda r: r.k)] == sorted((r.hot, r.id) for r in got)


def test_keys_put_nulls_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "a int")
    assert rows(assign_keys(df, "a")) == [(1, 1), (2, 2), (3, None)]


def test_clustered_write_and_lookup(spark, folder):
    df = spark.range(500).select("id", (F.col("id") % 3).cast("string").alias("p"), (F.col("id") % 50).alias("k"))
    write_clustered(df, folder + "/c", sort_by=["k", "id"], partition_by="p", partitions=4)
    back = spark.read.schema(df.schema).parquet(folder + "/c")
    assert rows(back.select(*df.columns)) == rows(df)
    found = lookup(back, {"p": "1", "k": 7})
    assert rows(found, "id") == rows(df.filter("p = '1' and k = 7"), "id")
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(k,7)" in plan and "PartitionFilters: [isnotnull(p" in plan


def test_lookup_of_null_finds_nothing(spark):
    df = spark.createDataFrame([(None,), (1,)], "a int")
    assert lookup(df, {"a": None}).count() == 0


def test_subset_keeps_true_only(spark, folder):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, f boolean")
    write_subset(df, F.col("f"), folder + "/s")
    assert rows(spark.read.parquet(folder + "/s"), "id") == [(1,)]


def test_spread_deals_out_only_when_asked(spark):
    df = spark.range(100, numPartitions=1)
    assert spread(df) is df
    assert spread(df, 16).select(F.spark_partition_id()).distinct().count() == 16


def test_policies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, s string")
    assert apply_policy(df).count() == 0
    assert apply_policy(df, True).count() == 3
    assert rows(apply_policy(df, F.col("s") == "a"), "id") == [(1,)]
    assert rows(apply_policy(df, F.col("s") == "a", F.col("id") == 3), "id") == [(1,), (3,)]
    assert "LocalTableScan <empty>" in apply_policy(df)._jdf.queryExecution().toString()


def test_instants(spark):
    one = spark.range(1)
    assert one.select(load_instant(AS_OF)).first()[0] == AS_OF
    wall = F.lit("2024-03-10 12:00:00").cast("timestamp")
    assert str(one.select(to_utc(wall, "Asia/Kolkata")).first()[0]) == "2024-03-10 06:30:00"


def test_register_gives_a_name(spark):
    register(spark, "some_name", spark.range(3))
    assert spark.sql("select count(*) from some_name").first()[0] == 3


def test_scan_uses_the_declared_schema(spark, folder):
    spark.range(3).write.parquet(folder + "/x")
    wide = T.StructType([T.StructField("id", T.LongType()), T.StructField("added", T.StringType())])
    assert rows(scan(spark, folder + "/x", wide)) == [(0, None), (1, None), (2, None)]


def test_bucketed_tables_join_without_an_exchange(spark, folder):
    parent = spark.range(100).withColumnRenamed("id", "k")
    child = spark.range(1000).select("id", (F.col("id") % 90).alias("up"))
    p = write_bucketed(parent, "b_parent", folder + "/p", "k", 4)
    c = write_bucketed(child, "b_child", folder + "/c", "up", 4)
    joined = c.hint("merge").join(p, F.col("up") == F.col("k"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert rows(joined, "id", "k") == rows(child.select("id", "up"))
    spark.sql("DROP TABLE b_parent")
    spark.sql("DROP TABLE b_child")


def test_one_sort_value_takes_several_ranges(spark, folder):
    """Two thirds of the rows share their sort key; ids stay dense and repeatable."""
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("hot"))
    first = assign_keys(df, "hot", key="k", partitions=8)
    again = assign_keys(df.orderBy(F.desc("id")), "hot", key="k", partitions=3)
    assert rows(first, "k", "id") == rows(again, "k", "id")
    assert [r[0] for r in first.select("k").orderBy("k").collect()] == list(range(1, 9001))
    write_clustered(df, folder + "/c", sort_by="hot", partitions=8)
    stored = spark.read.parquet(folder + "/c").groupBy(F.input_file_name().alias("f")).count()
    assert stored.agg(F.max("count")).first()[0] < 3000
    assert stored.agg(F.sum("count")).first()[0] == 9000
