import random

import pytest
from pyspark.sql import functions as F

from espalier.operators.hierarchy import Hierarchy, Level
from espalier.plans.star import sales
from tests.conftest import rows


@pytest.fixture(scope="module")
def tree(spark):
    branch = spark.createDataFrame([(1, "B1"), (2, "B2")], "id int, title string")
    course = spark.createDataFrame(
        [(10, 1, "c10"), (11, 1, "c11"), (12, 2, "c12"), (13, None, "lost")], "id int, up int, title string")
    unit = spark.createDataFrame(
        [(100, 10, "u100"), (101, 10, "u101"), (102, 12, "u102"), (103, 99, "orphan")], "id int, up int, title string")
    topic = spark.createDataFrame(
        [(1, 100, True, ["a", "b"]), (2, 100, False, None), (3, 100, None, []), (4, 102, True, ["z"]), (5, None, True, None)],
        "id int, up int, flag boolean, tags array<string>")
    return Hierarchy([
        Level("branch", branch, "id"), Level("course", course, "id", "up"),
        Level("unit", unit, "id", "up"), Level("topic", topic, "id", "up")])


COLS = {"branch": "branch.title", "course": "course.title", "unit": "unit.title", "topic": "topic.id"}


def test_full_keeps_units_without_topics_and_drops_courses_without_units(tree):
    assert rows(tree.full(COLS)) == [
        ("B1", "c10", "u100", 1), ("B1", "c10", "u100", 2), ("B1", "c10", "u100", 3),
        ("B1", "c10", "u101", None), ("B2", "c12", "u102", 4)]


def test_full_equals_the_left_join(tree):
    left = tree._down_to(2).join(tree._named(tree.levels[3]), tree._link(3), "left")
    assert rows(tree.full(COLS)) == rows(left.select(*[F.col(f"`{v}`").alias(k) for k, v in COLS.items()]))


def test_full_sorts_by_hidden_columns(tree):
    got = tree.full({"t": "topic.id"}, order_by=["branch.id", "unit.id", "topic.id"]).collect()
    assert [r.t for r in got] == [1, 2, 3, None, 4]


def test_flagged_drops_false_and_null(tree):
    got = tree.flagged(F.col("flag"), {**COLS, "tags": "topic.tags"})
    assert rows(got) == [("B1", "c10", "u100", 1, ["a", "b"]), ("B2", "c12", "u102", 4, ["z"])]


def test_children_of_a_middle_level(tree):
    assert rows(tree.children("course", {"c": "course.title", "b": "branch.title"})) == [
        ("c10", "B1"), ("c11", "B1"), ("c12", "B2")]


SUMMARY = [("c10", 2, 3, 1), ("c11", 0, 0, 0), ("c12", 1, 1, 1)]


def test_summary_keeps_zeros(tree):
    assert rows(tree.summary("course", F.col("flag"), {"c": "course.title"})) == SUMMARY
    assert rows(tree.summary_plain("course", F.col("flag"), {"c": "course.title"})) == SUMMARY


def test_summary_of_the_root_and_sorted(tree):
    got = tree.summary("branch", None, {"b": "branch.title"}, {"course": "courses"}, order_by=["branch.title"])
    assert [tuple(r) for r in got.collect()] == [("B1", 2, 2, 3), ("B2", 1, 1, 1)]


def test_summary_merges_nodes_that_look_alike(spark):
    top = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "id int, title string")
    low = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "id int, up int")
    chain = Hierarchy([Level("top", top, "id"), Level("low", low, "id", "up")])
    merged = chain.summary("top", None, {"t": "top.title"}, order_by=["top.title"], merge_equal=True)
    assert [tuple(r) for r in merged.collect()] == [("other", 0), ("same", 3)]
    assert rows(chain.summary("top", None, {"t": "top.title"})) == [("other", 0), ("same", 1), ("same", 2)]


def test_repeated_leaf_keys_count_once(spark):
    top = spark.createDataFrame([(1,), (2,)], "id int")
    leaf = spark.createDataFrame([(1, 1, True), (1, 1, False), (1, 2, None), (1, None, True)], "up int, no int, f boolean")
    chain = Hierarchy([Level("top", top, "id"), Level("leaf", leaf, ("up", "no"), "up", unique=False)])
    assert rows(chain.summary("top", F.col("f"), {"id": "top.id"})) == [(1, 2, 1), (2, 0, 0)]
    assert rows(chain.summary_plain("top", F.col("f"), {"id": "top.id"})) == [(1, 2, 1), (2, 0, 0)]


def test_one_parent_with_a_third_of_the_leaves(spark):
    """Same rows when nothing may be broadcast and skewed partitions split."""
    top = spark.range(200).withColumnRenamed("id", "k")
    leaf = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 190).alias("up"))
    chain = Hierarchy([Level("top", top, "k"), Level("leaf", leaf, "id", "up")])
    columns = {"k": "top.k", "id": "leaf.id"}
    expected = rows(chain.full(columns))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4KB")
    try:
        assert rows(chain.full(columns)) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(expected) == 6000 + 10


def test_ambiguous_columns_must_be_named(tree):
    with pytest.raises(ValueError, match="pass `columns`"):
        tree.full()


def test_building_a_question_starts_no_job(spark, tree):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        tree.full(COLS), tree.flagged(F.col("flag"), COLS), tree.summary("course", F.col("flag"), {"c": "course.title"})
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_full_with_null_and_repeated_parent_keys(spark):
    top = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (None, "e"), (None, "f")], "id int, t string")
    leaf = spark.createDataFrame([(1, 10), (None, 11), (9, 12)], "up int, no int")
    chain = Hierarchy([Level("top", top, "id", unique=False), Level("leaf", leaf, "no", "up")])
    assert rows(chain.full({"t": "top.t", "no": "leaf.no"})) == [
        ("a", 10), ("b", 10), ("c", None), ("d", None), ("e", None), ("f", None)]


def test_merged_rows_are_not_sorted_by_hidden_columns(tree):
    with pytest.raises(ValueError, match="don't show"):
        tree.summary("course", None, {"b": "branch.title"}, order_by=["course.title"], merge_equal=True)


# --- bitmaps ---------------------------------------------------------------


def test_keys_below_several_parents_count_once(spark):
    from espalier.operators.bitmaps import distinct_rollup

    rng = random.Random(6)
    top = [(i,) for i in range(5)] + [(None,)]
    mid = [(i, rng.choice([0, 1, 2, 3, None])) for i in range(30)] + [(None, 1)]
    leaf = [(rng.choice([None, 0, 40_000, 2**40, *range(50)]), rng.choice([None, *range(30)]), rng.random() < 0.5) for _ in range(400)]
    tree = Hierarchy([
        Level("top", spark.createDataFrame(top, "t long"), "t"),
        Level("mid", spark.createDataFrame(mid, "m long, up long"), "m", "up"),
        Level("leaf", spark.createDataFrame(leaf, "l long, over long, f boolean"), "l", "over", unique=False)])
    ids = {"mid": F.col("m"), "leaf": F.col("l")}
    columns = {"t": "top.t"}
    got = rows(tree.summary_bitmap("top", ids, F.col("f"), columns))
    assert got == rows(tree.summary_plain("top", F.col("f"), columns))
    hand = []
    for (t,) in top:
        ms = {m for m, up in mid if t is not None and up == t and m is not None}
        ls = {x for x, over, _ in leaf if over in ms and x is not None}
        hand.append((t, len(ms), len(ls), len({x for x, over, f in leaf if over in ms and x is not None and f})))
    assert got == sorted(hand, key=repr)
    frame = spark.createDataFrame([(a or 0, b or 0, c) for a, b, c in leaf], "l long, g long, f boolean").withColumn("h", F.col("g") % 3)
    rolled = distinct_rollup(frame, [["g", "h"], ["h"], []], F.col("l"), {"n": None, "m": F.col("f")})
    sets = {}
    for r in frame.collect():
        for at in ((0, r.g, r.h), (1, None, r.h), (2, None, None)):
            n, m = sets.setdefault(at, (set(), set()))
            n.add(r.l)
            m |= {r.l} if r.f else set()
    assert rows(rolled) == sorted(((*at, len(n), len(m)) for at, (n, m) in sets.items()), key=repr)
    with pytest.raises(ValueError):
        distinct_rollup(frame, [["g"], ["h"]], F.col("l"), {"n": None})


def test_bitmaps_copy_no_rows(spark):
    tree = sales(spark, "/root/testdata/sf0.001")
    ids = {"customer": F.col("c_custkey"), "orders": F.col("o_orderkey"), "lineitem": F.col("l_orderkey") * 8 + F.col("l_linenumber")}
    got = tree.summary_bitmap("nation", ids, F.col("l_returnflag") == "R", {"n": "nation.n_name"})
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(tree.summary("nation", F.col("l_returnflag") == "R", {"n": "nation.n_name"}))
