"""Every registered query against its SQL, and the catalogue's audit."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from espalier.plans.catalog import Catalog, catalog_specs
from espalier.plans.catalog_workload import derive

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, FOLDER)
    cur = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    ours = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    assert ours == theirs


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_derived_catalog_is_clean_and_fully_checked(spark):
    report = derive(spark, FOLDER).audit().collect()
    broken = [(r.table, r.constraint) for r in report if r.n_violations]
    assert {r.table for r in report} == set(catalog_specs("u")) and broken == [("open_electives", "semester_number 7 or 8")]
    assert len({(r.table, r.constraint, r.kind) for r in report}) == len(report)


def test_cascade_leaves_a_clean_catalog(spark):
    catalog = derive(spark, FOLDER)
    left = catalog.without_branches(F.col("id") == "ASIA", durable=True).surviving
    assert Catalog({**catalog.tables, **left}, catalog.specs).audit().filter("n_violations > 0 and table <> 'open_electives'").count() == 0


def test_catalog_views_sort_and_keep_zeros(spark):
    catalog = derive(spark, FOLDER)
    got = [(r.branch, r.sem, r.course_code) for r in catalog.subject_summary(ordered=True).collect()]
    assert got == sorted(got)
    got = [r.sem for r in catalog.high_yield_topics(ordered=True).collect()]
    assert got == sorted(got)
    labs = [(r.branch_name, r.semester_number, r.course_code, r.experiment_number)
            for r in catalog.lab_curriculum(ordered=True).collect()]
    assert labs == sorted(labs)
    fewer = {**catalog.tables, "course_units": catalog.tables["course_units"].filter("course_id <> 7")}
    summary = Catalog(fewer, catalog.specs).subject_summary()
    assert summary.filter("total_units = 0 and total_topics = 0").count() == 1
    assert summary.count() == catalog.tables["courses"].count()
