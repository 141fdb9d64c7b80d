"""Queries on keeping large tables up to date: appends, audits and layouts that
read only what a change touches. Each stands next to the SQL for its rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.durable import fresh_path
from espalier.operators.bitmaps import distinct_rollup
from espalier.operators.constraints import UniqueRule, offending_rows
from espalier.operators.hierarchy import Hierarchy, Level
from espalier.operators.keys import assign_keys
from espalier.operators.lookup import lookup
from espalier.operators.search import TitleIndex, index_pattern_search, index_search
from espalier.operators.tallies import Audit
from espalier.plans.star import CUSTOMER, ORDERS, STAR, table
from espalier.plans.workload import _BATCH, _sql_audit, _star, query, sql_trigrams
from espalier.sources.append import append_checked
from espalier.sources.ingest import conform, scan
from espalier.sources.layout import write_declared, write_z_ordered
from espalier.sources.publish import publish, read_published
from espalier.spec import Check, Column, TableSpec

# --- appends ---------------------------------------------------------------------

_BY_KEY = replace(ORDERS, name="orders_by_key", sort_by=("o_orderkey",))


@query(
    """
    SELECT 'row' AS what, o_orderkey AS n FROM orders
    UNION ALL SELECT 'refused ' || what, n FROM (
        SELECT 'o_orderkey' AS what, count(*) AS n FROM orders WHERE o_orderkey % 10 = 3 AND o_orderkey <= 500
        UNION ALL SELECT 'o_custkey->customer', count(*) FROM orders WHERE o_orderkey % 10 = 3 AND o_orderkey <= 500 AND o_custkey % 2 = 0)
    """
)
def append_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth order comes late to a table clustered by key; some come again, for customers that are gone."""
    orders, customers = (table(spark, folder, t) for t in ("orders", "customer"))
    path = fresh_path(spark, "orders-by-key")
    write_declared(orders.filter("o_orderkey % 10 <> 3"), _BY_KEY, path)
    late = orders.filter("o_orderkey % 10 = 3")
    append_checked(late, _BY_KEY, path, {"customer": customers})
    again = append_checked(late.filter("o_orderkey <= 500"), _BY_KEY, path, {"customer": customers.filter("c_custkey % 2 = 1")})
    broken = again.audit.filter("n_violations > 0").select(
        F.concat(F.lit("refused "), F.col("constraint")).alias("what"), F.col("n_violations").alias("n")
    )
    return scan(spark, path, _BY_KEY).select(F.lit("row").alias("what"), F.col("o_orderkey").alias("n")).unionByName(broken)


# --- publishing ------------------------------------------------------------------

_PRICED = replace(
    ORDERS,
    checks=(Check("o_totalprice <= 400000", lambda: F.col("o_totalprice") <= 400_000),),
    sort_by=("o_custkey",),
)


@query(
    """
    WITH o AS (SELECT * REPLACE (CASE WHEN o_orderkey % 1000 = 7 THEN NULL ELSE o_custkey END AS o_custkey) FROM orders),
    lines AS (
        SELECT 'orders' AS t, 'o_totalprice <= 400000' AS c, 'check' AS k, (SELECT count(*) FROM o WHERE o_totalprice > 400000) AS n
        UNION ALL SELECT 'orders', 'o_custkey', 'not_null', (SELECT count(*) FROM o WHERE o_custkey IS NULL)
        UNION ALL SELECT 'orders', 'o_custkey->customer', 'foreign_key',
                         (SELECT count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 4)))
    SELECT t AS "table", c AS "constraint", k AS kind, n AS n_violations FROM lines WHERE n > 0
    UNION ALL SELECT 'customer', 'read back', c_mktsegment, count(*) FROM customer WHERE c_custkey % 9 <> 4 GROUP BY 3
    """
)
def publish_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Customers are published; orders come as text, with faults that their write counts, and are refused."""
    target = fresh_path(spark, "observed")
    customers = table(spark, folder, "customer").filter("c_custkey % 9 <> 4")
    nations = {"nation": table(spark, folder, "nation")}
    publish(spark, {"customer": customers}, [CUSTOMER], target, nations)
    there = read_published(spark, target, STAR["customer"])
    orders = table(spark, folder, "orders")
    key = F.when(F.col("o_orderkey") % 1000 != 7, F.col("o_custkey").cast("string"))
    late = publish(spark, {"orders": orders.withColumn("o_custkey", key)}, [_PRICED], target, {"customer": there})
    counted = there.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_violations"))
    back = counted.select(
        F.lit("customer").alias("table"), F.lit("read back").alias("constraint"), F.col("c_mktsegment").alias("kind"), "n_violations"
    )
    return late.audit.filter("n_violations > 0").unionByName(back)


# --- audits ----------------------------------------------------------------------


@query("WITH customer AS (SELECT * FROM main.customer WHERE c_custkey % 50 <> 7)" + _sql_audit(*_BATCH))
def validate_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Tables are loaded, late orders and lines come in, customers leave, and some lines come and go."""
    tables, specs = _star(spark, folder, *_BATCH)
    audit = Audit(spark, fresh_path(spark, "audit"), specs)
    late = {"orders": "o_orderkey % 5 = 0", "lineitem": "l_orderkey % 5 = 0 or l_partkey % 11 = 0"}
    audit.apply("load", {n: df.filter(f"not ({late[n]})") if n in late else df for n, df in tables.items()})
    gone = {"customer": tables["customer"].filter("c_custkey % 50 = 7"), "lineitem": tables["lineitem"].filter("l_suppkey % 10 = 1")}
    added = {n: tables[n].filter(f) for n, f in late.items()}
    for _ in range(2):  # a batch counts once
        audit.apply("late", {**added, "lineitem": added["lineitem"].unionByName(gone["lineitem"])}, gone)
    audit.compact()
    return audit.apply("nothing", {"part": tables["part"].filter("p_partkey < 0")})


# --- distinct counts -------------------------------------------------------------


@query(
    """
    SELECT n_name, count(DISTINCT s_suppkey) AS n_supplier, count(DISTINCT l_partkey) AS n_part,
           count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS n_flagged
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey
    GROUP BY n_name
    """
)
def summary_bitmap(spark: SparkSession, folder: str) -> DataFrame:
    """Parts hang below every supplier that has sold them, and count once per nation."""
    tables = {n: table(spark, folder, n) for n in ("region", "nation", "supplier", "lineitem")}
    tree = Hierarchy(
        [
            Level("region", tables["region"], "r_regionkey"),
            Level("nation", tables["nation"], "n_nationkey", "n_regionkey"),
            Level("supplier", tables["supplier"], "s_suppkey", "s_nationkey"),
            Level("part", tables["lineitem"], "l_partkey", "l_suppkey", unique=False),
        ]
    )
    ids = {"supplier": F.col("s_suppkey"), "part": F.col("l_partkey")}
    return tree.summary_bitmap("nation", ids, F.col("l_returnflag") == "R", {"n_name": "nation.n_name"})


@query(
    """
    SELECT CAST(CASE WHEN grouping(month) = 0 THEN 0 WHEN grouping(year) = 0 THEN 1 ELSE 2 END AS INTEGER) AS level,
           coalesce(year::VARCHAR, '-') AS year, coalesce(month::VARCHAR, '-') AS month,
           count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS done
    FROM (SELECT *, year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders)
    GROUP BY GROUPING SETS ((year, month), (year), ())
    """
)
def distinct_by_time(spark: SparkSession, folder: str) -> DataFrame:
    """Customers per month, year and in all: years are merged from months, orders are read once."""
    dated = table(spark, folder, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    counts = {"customers": None, "done": F.col("o_orderstatus") == "F"}
    rolled = distinct_rollup(dated, [["year", "month"], ["year"], []], F.col("o_custkey"), counts)
    return rolled.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("year", "month")})


# --- lookups ---------------------------------------------------------------------


@query(
    """
    SELECT 'part' AS wanted, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 77
    UNION ALL SELECT 'supplier', l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey = 7
    UNION ALL SELECT 'both', l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 77 AND l_suppkey = 7
    """
)
def lookup_zorder(spark: SparkSession, folder: str) -> DataFrame:
    """One layout that serves lookups by either column, and by both."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    path = fresh_path(spark, "z-ordered")
    write_z_ordered(lines, path, ["l_partkey", "l_suppkey"])
    stored = spark.read.schema(lines.schema).parquet(path)
    wanted = {"part": {"l_partkey": 77}, "supplier": {"l_suppkey": 7}, "both": {"l_partkey": 77, "l_suppkey": 7}}
    found = [lookup(stored, by).select(F.lit(name).alias("wanted"), "*") for name, by in wanted.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


# --- titles ----------------------------------------------------------------------

_SQL_NOW = """
    now AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'new ' || p_name ELSE p_name END AS title FROM part
            WHERE p_partkey % 7 <> 2)
"""


def _changed_titles(spark: SparkSession, folder: str) -> tuple[TitleIndex, DataFrame]:
    """An index of all parts but some, after parts have left, got new titles and come late."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("title"))
    renamed = F.col("p_partkey") % 5 == 1
    now = parts.filter("p_partkey % 7 <> 2").withColumn("title", F.when(renamed, F.concat(F.lit("new "), "title")).otherwise(F.col("title")))
    index = TitleIndex(spark, fresh_path(spark, "titles"), "p_partkey", "title")
    late, old = F.col("p_partkey") % 3 == 0, parts.filter("p_partkey % 3 <> 0")
    index.apply("load", old)
    index.apply("gone", removed=old.filter("p_partkey % 7 = 2"))
    index.apply("renamed", now.filter(~late & renamed), old.filter("p_partkey % 7 <> 2").filter(renamed))
    for _ in range(2):  # a batch counts once
        index.apply("late", now.filter(late))
    return index, now


@query(
    f"""
    WITH {_SQL_NOW}
    SELECT trigram, p_partkey, CAST(n AS INTEGER) AS set_size
    FROM (SELECT p_partkey, unnest({sql_trigrams('title')}) AS trigram, len({sql_trigrams('title')}) AS n FROM now)
    """
)
def index_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    index, _ = _changed_titles(spark, folder)
    return index.read().select("trigram", "p_partkey", "set_size")


@query(
    f"""
    WITH {_SQL_NOW}, wanted AS (SELECT {sql_trigrams("'new red wid'")} AS w),
    scored AS (SELECT p_partkey, len(list_intersect({sql_trigrams('title')}, w)) AS s,
                      len(list_distinct({sql_trigrams('title')} || w)) AS c FROM now, wanted)
    SELECT 'fuzzy' AS how, p_partkey FROM scored WHERE s * 10 >= c * 3
    UNION ALL SELECT 'pattern', p_partkey FROM now WHERE title ILIKE 'new %id%ge_'
    """
)
def searches_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A fuzzy search and a pattern of several trigrams, before and after the runs are merged."""
    index, now = _changed_titles(spark, folder)
    fuzzy = index_search(index.read(), "p_partkey", "new red wid").select(F.lit("fuzzy").alias("how"), "p_partkey")
    index.compact()
    pattern = index_pattern_search(index.read(), now, "p_partkey", "title", "new %id%ge_")
    return fuzzy.unionByName(pattern.select(F.lit("pattern").alias("how"), "p_partkey"))


# --- collations ------------------------------------------------------------------

_NAMED = TableSpec(
    "named",
    (Column("p_partkey", T.LongType()), Column("title", T.StringType(), collation="UTF8_LCASE", max_length=80)),
    unique=(("title",),),
)


@query(
    """
    WITH named AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS title FROM part),
    places AS (SELECT lower(title) AS t, row_number() OVER (ORDER BY lower(title)) AS place FROM named GROUP BY 1)
    SELECT p_partkey, title, place, n FROM (SELECT *, count(*) OVER (PARTITION BY lower(title)) AS n FROM named)
    JOIN places ON t = lower(title) WHERE n > 1
    """
)
def sorted_collated(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that differ in case only break a key of a caseless column, and share a place in its order."""
    loud = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    parts = table(spark, folder, "part").select("p_partkey", loud.alias("title"))
    path = fresh_path(spark, "named")
    conform(parts, _NAMED).write.parquet(path)
    named = scan(spark, path, _NAMED)
    titles = named.groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    places = assign_keys(titles, "title", key="place").withColumnRenamed("title", "t")
    broken = offending_rows(named, UniqueRule(("title",)))
    return broken.join(places, F.col("title") == F.col("t")).select(
        "p_partkey", F.col("title").cast("string").alias("title"), "place", "n"
    )
