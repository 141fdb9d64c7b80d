import pytest
from pyspark.sql import types as T

from espalier.sources.append import append_checked
from espalier.sources.ingest import scan
from espalier.spec import Column, ForeignKey, TableSpec
from tests.conftest import rows

UP = ForeignKey(("up",), "node", ("id",))
NODE = TableSpec(
    "node",
    (Column("id", T.LongType(), required=True, generated=True), Column("code", T.StringType(), max_length=3), Column("up", T.LongType())),
    primary_key=("id",), unique=(("code",),), foreign_keys=(UP,))


def _frame(spark, data, schema="id long, code string, up long"):
    return spark.createDataFrame(data, schema)


def _broken(done):
    return sorted((r.constraint, r.n_violations) for r in done.audit.collect() if r.n_violations)


def test_ids_go_on_from_the_last_one(spark, folder):
    path = folder + "/t"
    assert append_checked(_frame(spark, [(5, "a", None)]), NODE, path).committed
    more = _frame(spark, [("c", 5), ("b", None)], "code string, up long")
    assert append_checked(more, NODE, path, order_by="code").committed
    assert rows(scan(spark, path, NODE)) == [(5, "a", None), (6, "b", None), (7, "c", 5)]


def test_a_batch_with_a_broken_row_adds_nothing(spark, folder):
    path = folder + "/t"
    append_checked(_frame(spark, [(1, "a", None), (2, None, 1)]), NODE, path)
    batch = _frame(spark, [(1, "b", 1), (3, "a", 9), (4, None, 3), (4, None, 2), (None, "w", None)])
    done = append_checked(batch, NODE, path)
    assert not done.committed
    # Id 4 twice, a taken id 1 and a missing one; a taken code; a parent 9 that isn't there.
    assert _broken(done) == [("code", 1), ("id", 1), ("id", 4), ("up->node", 1)]
    assert scan(spark, path, NODE).count() == 2


def test_an_empty_batch_and_absent_parents(spark, folder):
    assert append_checked(_frame(spark, []), NODE, folder + "/t").committed
    other = TableSpec("other", (Column("up", T.LongType()),), foreign_keys=(UP,))
    with pytest.raises(ValueError, match="refers to node"):
        append_checked(spark.createDataFrame([], "up long"), other, folder + "/o")


def test_unknown_columns_and_misfits_are_findings(spark, folder):
    done = append_checked(_frame(spark, [("x", "a", 1)], "id string, code string, more int"), NODE, folder + "/t")
    assert not done.committed and _broken(done) == [("id", 1), ("more", 1)]
    done = append_checked(_frame(spark, [(1, "wide", None)]), NODE, folder + "/t")
    assert not done.committed and _broken(done) == [("code", 1)]
