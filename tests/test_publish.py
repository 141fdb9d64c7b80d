import pytest
from pyspark.sql import functions as F

from espalier.plans.catalog import catalog_specs
from espalier.sources.ingest import conform, literal_rows
from espalier.sources.publish import current_run, publish, read_published
from tests.conftest import rows

SPECS = catalog_specs("Example University")
BRANCH, SEMESTER = SPECS["branches"], SPECS["semesters"]


def _batch(spark, number):
    branches = literal_rows(spark, [("A", "a", "n", "s")], BRANCH, ["id", "code", "name", "effective_session"])
    semesters = literal_rows(spark, [(1, "A", number, 1, "t")], SEMESTER)
    return {"branches": conform(branches, BRANCH), "semesters": conform(semesters, SEMESTER)}


def test_only_a_clean_batch_becomes_visible(spark, folder):
    specs = [BRANCH, SEMESTER]
    assert current_run(spark, folder) is None
    with pytest.raises(LookupError):
        read_published(spark, folder, SEMESTER)
    first = publish(spark, _batch(spark, 1), specs, folder)
    assert first.committed and current_run(spark, folder) == first.run
    bad = publish(spark, _batch(spark, 9), specs, folder)
    assert not bad.committed
    broken = [r for r in bad.audit.collect() if r.n_violations]
    assert [(r.table, r.constraint) for r in broken] == [("semesters", "semester_number 1..8")]
    assert rows(read_published(spark, folder, SEMESTER), "semester_number") == [(1,)]
    publish(spark, _batch(spark, 2), specs, folder)
    assert rows(read_published(spark, folder, SEMESTER), "semester_number") == [(2,)]


def test_a_misnamed_column_is_a_finding(spark, folder):
    batch = _batch(spark, 1)
    batch["semesters"] = batch["semesters"].withColumnRenamed("academic_title", "title")
    found = publish(spark, batch, [BRANCH, SEMESTER], folder)
    assert not found.committed and current_run(spark, folder) is None
    assert [tuple(r) for r in found.audit.collect()] == [("semesters", "title", "unknown_column", 1)]


def test_each_table_is_read_from_the_last_commit_that_names_it(spark, folder):
    batch = _batch(spark, 1)
    assert publish(spark, {"branches": batch["branches"]}, [BRANCH], folder).committed
    parents = {"branches": read_published(spark, folder, BRANCH)}
    assert publish(spark, {"semesters": batch["semesters"]}, [SEMESTER], folder, parents).committed
    assert read_published(spark, folder, BRANCH).count() == read_published(spark, folder, SEMESTER).count() == 1


def test_each_row_is_read_once(spark, folder):
    """The write counts what breaks a rule: an accumulator sees every row of the batch once."""
    seen = spark.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    source = spark.range(50).select(F.udf(look, "long").asNondeterministic()("id").alias("id"))
    branches = source.select(*[F.lit("x").alias(c.name) if c.name != "id" else F.concat(F.lit("b"), F.col("id")).alias("id") for c in BRANCH.columns if c.name != "created_at"])
    branches = branches.withColumns({c: F.concat(F.lit("c"), F.col("id")) for c in ("code",)})
    loose = branches.select(*[F.col(c).cast(BRANCH.column(c).type).alias(c) if BRANCH.column(c).type.simpleString() == "string" else F.lit("1").alias(c) for c in branches.columns])
    done = publish(spark, {"branches": loose}, [BRANCH], folder)
    assert seen.value == 50, [tuple(r) for r in done.audit.filter("n_violations > 0").collect()]


def test_values_that_do_not_fit_are_counted_and_stop_the_batch(spark, folder):
    rows_ = spark.createDataFrame([("1", "A", "1"), ("2", "A", "two"), ("3", "A", "99999999999"), ("x", None, None)], "id string, branch_id string, semester_number string")
    batch = {"semesters": rows_}
    done = publish(spark, batch, [SEMESTER], folder, {"branches": _batch(spark, 1)["branches"]})
    assert not done.committed
    assert sorted((r.constraint, r.kind, r.n_violations) for r in done.audit.collect()) == [("id", "type", 1), ("semester_number", "type", 2)]


def test_a_batch_without_rows_is_clean(spark, folder):
    batch = {name: df.limit(0) for name, df in _batch(spark, 1).items()}
    empty = {"branches": spark.createDataFrame([], BRANCH.schema), "semesters": batch["semesters"].filter("false")}
    done = publish(spark, empty, [BRANCH, SEMESTER], folder)
    assert done.committed and done.audit.count() > 10
    assert read_published(spark, folder, BRANCH).count() == 0


def test_another_fault_is_not_taken_for_a_first_publication(spark, folder):
    import os

    os.makedirs(folder + "/manifests")
    with open(folder + "/manifests/part.json", "w") as file:
        file.write("{not json")
    assert current_run(spark, folder) is None  # no row names a run
    with pytest.raises(Exception):
        current_run(spark, "nosuchscheme://" + folder)


def test_rules_are_counted_once_in_a_declared_layout(spark, folder):
    from dataclasses import replace

    clustered = replace(SEMESTER, partition_by=("branch_id",), sort_by=("semester_number", "id"))
    many = spark.range(200).select(F.col("id").cast("int").alias("id"), F.lit("A").alias("branch_id"), (F.col("id") % 10).cast("string").alias("semester_number"), F.lit("t").alias("academic_title"))
    assert set(many.columns) <= {c.name for c in SEMESTER.columns}
    done = publish(spark, {"semesters": many}, [clustered], folder, {"branches": _batch(spark, 1)["branches"]})
    assert {(r.constraint, r.n_violations) for r in done.audit.collect() if r.kind == "check"} >= {("semester_number 1..8", 40)}
