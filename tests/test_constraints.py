from pyspark.sql import functions as F

from espalier.operators import constraints as C
from espalier.spec import Check, Column, Domain, ForeignKey, TableSpec
from pyspark.sql import types as T
from tests.conftest import rows


def n(report):
    return [r.n_violations for r in report.collect()]


def _child(spark):
    return spark.createDataFrame([(1, 10), (2, None), (3, 99), (4, 99), (None, 10), (1, 11)], "id int, parent int")


def _parent(spark):
    return spark.createDataFrame([(10,), (11,)], "pk int")


def test_not_null_counts_each_column_in_one_pass(spark):
    report = C.check_not_null(_child(spark), ["id", "parent"], "child")
    assert rows(report) == [("child", "id", "not_null", 1), ("child", "parent", "not_null", 1)]
    assert report._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_unique_ignores_nulls_and_primary_key_does_not(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "k int")
    assert n(C.check_unique(df, "k")) == [3]
    assert n(C.check_primary_key(df, "k")) == [5]
    assert rows(C.duplicate_keys(df, "k")) == [(1, 3)]
    assert rows(C.offending_rows(df, C.UniqueRule(("k",)))) == [(1,)] * 3
    assert rows(C.offending_rows(df, C.UniqueRule(("k",), required=True))) == [(1,)] * 3 + [(None,)] * 2


def test_composite_unique_with_partial_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, None)], "a int, b int")
    assert n(C.check_unique(df, ["a", "b"])) == [2]
    assert n(C.check_primary_key(df, ["a", "b"])) == [4]


def test_clean_and_empty_tables_report_zero(spark):
    empty = spark.createDataFrame([], "k int")
    assert n(C.check_unique(empty, "k")) == [0]
    assert n(C.check_not_null(empty, "k")) == [0]
    assert n(C.check_foreign_key(empty, "k", empty, "k")) == [0]


def test_check_passes_on_unknown(spark):
    df = spark.createDataFrame([(0,), (1,), (8,), (9,), (None,)], "x int")
    assert n(C.check(df, F.col("x").between(1, 8), "range")) == [2]
    assert n(C.check(df, F.col("x").isin(1, 8), "listed")) == [2]
    rule = C.satisfies(F.col("x").between(1, 8), "range")
    assert rows(C.offending_rows(df, rule)) == [(0,), (9,)]


def test_foreign_key_null_passes_and_repeats_count(spark):
    report = C.check_foreign_key(_child(spark), "parent", _parent(spark), "pk", "child", "par")
    assert rows(report) == [("child", "parent->par", "foreign_key", 2)]
    key = ForeignKey(("parent",), "par", ("pk",))
    assert rows(C.offending_rows(_child(spark), key, _parent(spark))) == [(3, 99), (4, 99)]


def test_composite_foreign_key(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (1, None), (None, 5)], "a int, b int")
    parent = spark.createDataFrame([(1, 1)], "x int, y int")
    assert n(C.check_foreign_key(child, ["a", "b"], parent, ["x", "y"])) == [1]


def test_foreign_key_onto_the_same_table(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 9)], "id int, up int")
    assert n(C.check_foreign_key(df, "up", df, "id")) == [1]


def test_domain_and_length(spark):
    df = spark.createDataFrame([("a",), ("b",), ("bbb",), ("bb   ",), (None,)], "s string")
    assert n(C.check_domain(df, "s", Domain("d", ("a", "b")))) == [2]
    assert n(C.check_length(df, "s", 2)) == [1]


def test_hot_key_is_one_record_after_the_map_side(spark):
    """A key on a third of the rows is combined before the exchange."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    assert n(C.check_unique(df, "k")) == [3001]
    plan = C.check_unique(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("hashpartitioning")  # below it in the tree


def test_validate_covers_every_declared_rule(spark):
    dom = Domain("d", ("x", "y"))
    par = TableSpec("par", (Column("pk", T.IntegerType(), required=True),), primary_key=("pk",))
    kid = TableSpec(
        "kid",
        (Column("id", T.IntegerType(), required=True), Column("parent", T.IntegerType()),
         Column("s", T.StringType(), max_length=1, domain=dom)),
        primary_key=("id",), unique=(("parent",),),
        checks=(Check("id small", lambda: F.col("id") < 4),),
        foreign_keys=(ForeignKey(("parent",), "par", ("pk",)),),
    )
    tables = {"par": _parent(spark),
              "kid": _child(spark).withColumn("s", F.when(F.col("id") > 2, "zz").otherwise("x"))}
    got = {(r.table, r.constraint, r.kind): r.n_violations for r in C.validate(tables, [par, kid]).collect()}
    assert got == {
        ("par", "pk", "not_null"): 0, ("par", "pk", "primary_key"): 0,
        ("kid", "id", "not_null"): 1, ("kid", "s", "length"): 2, ("kid", "s", "domain"): 2,
        ("kid", "id small", "check"): 1, ("kid", "id", "primary_key"): 3,
        ("kid", "parent", "unique"): 4, ("kid", "parent->par", "foreign_key"): 2,
    }


def test_parent_key_repeated_many_times(spark):
    child = spark.createDataFrame([(1,), (1,), (9,)], "fk int")
    parent = spark.range(3000).select(F.lit(1).alias("pk"))
    assert n(C.check_foreign_key(child, "fk", parent, "pk")) == [1]
    key = ForeignKey(("fk",), "p", ("pk",))
    assert rows(C.offending_rows(child, key, parent)) == [(9,)]
