from pyspark.sql import functions as F

import pytest

from espalier.operators.cascade import cascade_delete
from espalier.operators.constraints import check_foreign_key
from espalier.spec import ForeignKey
from tests.conftest import rows


def _graph(spark):
    tables = {
        "root": spark.createDataFrame([(1, "go"), (2, "stay"), (3, None)], "id int, s string"),
        "mid": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, root int"),
        # A diamond: both through mid and directly.
        "leaf": spark.createDataFrame(
            [("both", 10, 1), ("mid only", 10, 2), ("direct only", 11, 1), ("none", 11, 2), ("null", None, None),
             ("both", 10, 1)], "name string, mid int, root int"),
        "apart": spark.createDataFrame([(1,)], "id int"),
    }
    keys = {
        "mid": [ForeignKey(("root",), "root", ("id",))],
        "leaf": [ForeignKey(("mid",), "mid", ("id",)), ForeignKey(("root",), "root", ("id",))],
    }
    return tables, keys


@pytest.mark.parametrize("durable", [False, True])
def test_diamond(spark, durable):
    tables, keys = _graph(spark)
    got = cascade_delete(tables, keys, "root", F.col("s") == "go", durable)
    assert rows(got.deleted["root"], "id") == [(1,)]
    assert rows(got.surviving["root"], "id") == [(2,), (3,)]
    assert rows(got.deleted["mid"], "id") == [(10,)]
    assert rows(got.surviving["mid"], "id") == [(11,), (12,)]
    assert rows(got.deleted["leaf"], "name") == [("both",), ("both",), ("direct only",), ("mid only",)]
    assert rows(got.surviving["leaf"], "name") == [("none",), ("null",)]
    assert "apart" not in got.deleted
    assert rows(got.counts()) == [("leaf", 4), ("mid", 1), ("root", 1)]
    assert got.deleted["leaf"].columns == tables["leaf"].columns


def test_nothing_dangles_afterwards(spark):
    tables, keys = _graph(spark)
    left = cascade_delete(tables, keys, "root", F.col("s") == "go").surviving
    for child, links in keys.items():
        for k in links:
            report = check_foreign_key(left[child], k.columns, left[k.parent], k.parent_columns)
            assert report.first().n_violations == 0


def test_start_in_the_middle(spark):
    tables, keys = _graph(spark)
    got = cascade_delete(tables, keys, "mid", F.col("id") == 11)
    assert rows(got.deleted["leaf"], "name") == [("direct only",), ("none",)]
    assert "root" not in got.deleted


def test_a_lone_root_is_deleted_from_and_others_stay(spark):
    tables = {"a": spark.range(5), "b": spark.range(3)}
    done = cascade_delete(tables, {}, "a", F.col("id") < 2)
    assert done.deleted["a"].count() == 2 and done.surviving["a"].count() == 3
    assert done.surviving["b"].count() == 3 and "b" not in done.deleted


def test_each_table_is_read_once_and_counted(spark):
    """A durable cascade marks every table in one job, however many lie below it."""
    seen = {name: spark.sparkContext.accumulator(0) for name in ("a", "b", "c", "d")}

    def watched(name, data, columns):
        def look(value):
            seen[name].add(1)
            return value

        frame = spark.createDataFrame(data, columns)
        return frame.withColumn("id", F.udf(look, "long").asNondeterministic()("id"))

    tables = {
        "a": watched("a", [(i,) for i in range(4)], "id long"),
        "b": watched("b", [(i, i % 4) for i in range(20)], "id long, a long"),
        "c": watched("c", [(i, i % 20) for i in range(60)], "id long, b long"),
        "d": watched("d", [(i, i % 60, i % 4) for i in range(90)], "id long, c long, a long"),
    }
    keys = {
        "b": [ForeignKey(("a",), "a", ("id",))],
        "c": [ForeignKey(("b",), "b", ("id",))],
        "d": [ForeignKey(("c",), "c", ("id",)), ForeignKey(("a",), "a", ("id",))],
    }
    done = cascade_delete(tables, keys, "a", F.col("id") == 1, durable=True)
    assert rows(done.counts()) == sorted([("a", 1), ("b", 5), ("c", 15), ("d", 23)], key=repr)
    assert all(seen[n].value <= df for n, df in (("a", 4), ("b", 20), ("c", 60), ("d", 90)))
    assert rows(done.deleted["d"], "id") == sorted([(i,) for i in range(90) if i % 60 % 20 % 4 == 1 or i % 4 == 1], key=repr)
