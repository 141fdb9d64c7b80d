"""The running audit against a whole one, after every batch."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.operators.constraints import validate
from espalier.operators.tallies import Audit
from espalier.spec import Check, Column, ForeignKey, TableSpec
from tests.conftest import rows

UP = TableSpec(
    "up", (Column("a", T.IntegerType()), Column("b", T.StringType(), max_length=2), Column("c", T.LongType(), required=True)),
    primary_key=("a", "b"), unique=(("c",),), checks=(Check("c < 9", lambda: F.col("c") < 9),),
    foreign_keys=(ForeignKey(("c",), "up", ("c",)),))
LOW = TableSpec(
    "low", (Column("x", T.LongType()), Column("y", T.StringType()), Column("z", T.LongType())),
    foreign_keys=(ForeignKey(("x", "y"), "up", ("a", "b")), ForeignKey(("z",), "up", ("c",))))
SPECS = [UP, LOW]


def _frame(spark, spec, data):
    return spark.createDataFrame(data, spec.schema)


def _whole(spark, state):
    return rows(validate({s.name: _frame(spark, s, state[s.name]) for s in SPECS}, SPECS))


def _random_rows(dice, spec, n):
    def cell(kind):
        return None if dice.random() < 0.1 else dice.choice("pqr") * dice.randint(1, 3) if isinstance(kind, T.StringType) else dice.randint(0, 11)

    return [tuple(cell(c.type) for c in spec.columns) for _ in range(n)]


def test_every_batch_gives_the_report_of_the_whole(spark, folder):
    dice = random.Random(4)
    audit = Audit(spark, folder, SPECS)
    state = {"up": [], "low": []}
    assert rows(audit.report()) == _whole(spark, state)
    for batch in range(5):
        added = {s.name: _random_rows(dice, s, dice.choice([0, 3, 15])) for s in SPECS if dice.random() < 0.8}
        gone = {n: dice.sample(state[n], len(state[n]) // 3) for n in state if dice.random() < 0.7}
        for n, some in gone.items():
            for row in some:
                state[n].remove(row)
        for n, some in added.items():
            state[n] += some
        audit.apply(f"b{batch}", *[{n: _frame(spark, dict(zip(("up", "low"), SPECS))[n], d) for n, d in part.items()} for part in (added, gone)])
        assert rows(audit.report()) == _whole(spark, state), batch
        if batch == 2:
            audit.compact()
            assert rows(audit.report()) == _whole(spark, state)
    assert any(r[3] for r in _whole(spark, state))
    before = rows(audit.report())
    audit.apply("b1", {"up": _frame(spark, UP, [(1, "p", 1)] * 5)})
    assert rows(audit.report()) == before
    assert rows(Audit(spark, folder, SPECS).report()) == before


def test_runs_are_merged(spark, folder, monkeypatch):
    monkeypatch.setattr("espalier.operators.tallies.MOST_RUNS", 2)
    audit = Audit(spark, folder, SPECS)
    for i in range(4):
        audit.apply(str(i), {"up": _frame(spark, UP, [(i, "p", 5)])})
    assert len(audit._state()[1]) <= 2
    assert rows(audit.report()) == _whole(spark, {"up": [(i, "p", 5) for i in range(4)], "low": []})


def test_only_touched_keys_are_looked_up(spark, folder):
    audit = Audit(spark, folder, SPECS)
    audit.apply("load", {"up": spark.range(20_000).select(F.col("id").cast("int").alias("a"), F.lit("p").alias("b"), F.col("id").alias("c"))})
    key = audit.keys[1]  # by c
    assert key.columns == ("c",)
    delta = spark.createDataFrame([(7, 1, 0, 0), (9, -1, 0, 0)], "__k0 long, __n0 long, __n1 long, __n2 long")
    changes = audit._key_changes(key, delta, audit._kept(1, key, audit._state()[1]))
    plan = changes._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(__k0,7)" in plan.replace(" ", "") or "EqualTo(__k0,7)" in plan.replace(" ", "")
    assert {(r.constraint, r.kind): r.n_violations for r in changes.collect()}[("c", "unique")] == 2


def test_a_missing_parent_table_is_refused(spark, folder):
    with pytest.raises(ValueError):
        Audit(spark, folder, [LOW])
