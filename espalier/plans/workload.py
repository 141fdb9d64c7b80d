"""The registered queries, each next to the SQL that must give the same rows.

Columns that two engines print differently (decimals, timestamps, arrays) leave
a query as doubles, text or scalars.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.durable import fresh_path
from espalier.functions.once import with_once
from espalier.functions.timeutil import to_utc
from espalier.functions.trigram import Threshold, combined, ratio, shared, trigrams
from espalier.functions.types import to_numeric, to_varchar
from espalier.operators import constraints as C
from espalier.operators.cascade import Cascade, cascade_delete
from espalier.operators.hierarchy import Hierarchy, Level
from espalier.operators.keys import assign_keys, last_key
from espalier.operators.lookup import lookup
from espalier.operators.policy import apply_policy
from espalier.operators.search import (
    fuzzy_search,
    index_pattern_search,
    index_search,
    pattern_search,
    trigram_index,
    write_index,
)
from espalier.operators.similarity import similar_sets, similarity_join, similarity_self_join
from espalier.plans.star import EVENT, PRIORITY, STAR, sales, table
from espalier.sources.append import append_checked as add_checked
from espalier.sources.ingest import append_rows, conform, register, scan, write_table
from espalier.sources.layout import spread, write_bucketed, write_clustered, write_subset
from espalier.sources.publish import publish, read_published
from espalier.spec import ABSENT
from espalier.spec import Column as Declared
from espalier.spec import ForeignKey, TableSpec

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function with its SQL, under `name` or its own name."""

    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        ORACLE[name or fn.__name__] = sql
        return fn

    return add


def _stamp(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def _stored(df: DataFrame, label: str) -> str:
    """A folder of its own for a query that writes before it reads."""
    return fresh_path(df.sparkSession, label)


def sql_trigrams(text: str) -> str:
    """The trigram set of an SQL text expression."""
    return (
        f"list_distinct(flatten(list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), "
        "lambda w: list_transform(range(1, length(w) + 2), "
        "lambda i: substring('  ' || w || ' ', CAST(i AS INTEGER), 3)))))"
    )


# --- hierarchy -----------------------------------------------------------

FULL = {
    "r_name": "region.r_name",
    "n_name": "nation.n_name",
    "c_custkey": "customer.c_custkey",
    "o_orderkey": "orders.o_orderkey",
    "o_orderpriority": "orders.o_orderpriority",
    "l_linenumber": "lineitem.l_linenumber",
    "l_partkey": "lineitem.l_partkey",
    "l_returnflag": "lineitem.l_returnflag",
}


def _nullable_as_text(df: DataFrame) -> DataFrame:
    """Whole numbers that may be NULL print alike only as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("l_linenumber", "l_partkey")})


@query(
    """
    SELECT r_name, n_name, c_custkey, o_orderkey, o_orderpriority, l_linenumber::VARCHAR AS l_linenumber,
           l_partkey::VARCHAR AS l_partkey, l_returnflag
    FROM orders
    JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN lineitem ON l_orderkey = o_orderkey
    """
)
def hierarchy_full(spark: SparkSession, folder: str) -> DataFrame:
    return _nullable_as_text(sales(spark, folder).full(FULL))


@query(ORACLE["hierarchy_full"])
def hierarchy_full_sorted(spark: SparkSession, folder: str) -> DataFrame:
    order = ["region.r_regionkey", "nation.n_name", "customer.c_custkey", "orders.o_orderkey", "lineitem.l_linenumber"]
    return _nullable_as_text(sales(spark, folder).full(FULL, order_by=order))


@query(
    """
    SELECT r_name, n_name, c_name, o_orderkey, l_linenumber, l_shipdate::DATE::VARCHAR AS shipped,
           l_returnflag || '/' || l_linestatus AS tags
    FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey
    WHERE l_returnflag = 'R'
    """
)
def hierarchy_flagged(spark: SparkSession, folder: str) -> DataFrame:
    tagged = table(spark, folder, "lineitem").withColumn("tags", F.array("l_returnflag", "l_linestatus"))
    flagged = sales(spark, folder, lineitem=tagged).flagged(
        F.col("l_returnflag") == "R",
        {
            "r_name": "region.r_name",
            "n_name": "nation.n_name",
            "c_name": "customer.c_name",
            "o_orderkey": "orders.o_orderkey",
            "l_linenumber": "lineitem.l_linenumber",
            "shipped": "lineitem.l_shipdate",
            "tags": "lineitem.tags",
        },
    )
    return flagged.withColumn("shipped", F.date_format("shipped", "yyyy-MM-dd")).withColumn(
        "tags", F.array_join("tags", "/")
    )


@query(
    """
    SELECT r_name, n_name, c_name, o_orderkey, o_orderstatus, o_totalprice
    FROM orders, customer, nation, region
    WHERE c_custkey = o_custkey AND n_nationkey = c_nationkey AND r_regionkey = n_regionkey
    """
)
def hierarchy_children(spark: SparkSession, folder: str) -> DataFrame:
    return sales(spark, folder).children(
        "orders",
        {
            "r_name": "region.r_name",
            "n_name": "nation.n_name",
            "c_name": "customer.c_name",
            "o_orderkey": "orders.o_orderkey",
            "o_orderstatus": "orders.o_orderstatus",
            "o_totalprice": "orders.o_totalprice",
        },
    )


SUMMARY = {"r_name": "region.r_name", "n_name": "nation.n_name", "c_custkey": "customer.c_custkey"}
SUMMARY_COUNTS = {"orders": "n_orders", "lineitem": "n_lines", "flag": "n_flagged"}


def _urgent(spark: SparkSession, folder: str) -> Hierarchy:
    urgent = table(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return sales(spark, folder, orders=urgent)


@query(
    """
    WITH line AS (
      SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS flagged
      FROM lineitem GROUP BY ALL HAVING l_linenumber IS NOT NULL
    ), ordr AS (
      SELECT o_custkey, o_orderkey, count(l_linenumber) AS lines, count(*) FILTER (WHERE flagged) AS flagged
      FROM orders LEFT JOIN line ON l_orderkey = o_orderkey
      WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey, o_orderkey
    )
    SELECT r_name, n_name, c_custkey, count(o_orderkey) AS n_orders,
           CAST(coalesce(sum(lines), 0) AS BIGINT) AS n_lines,
           CAST(coalesce(sum(flagged), 0) AS BIGINT) AS n_flagged
    FROM customer
    JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN ordr ON o_custkey = c_custkey
    GROUP BY r_name, n_name, c_custkey
    """
)
def hierarchy_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _urgent(spark, folder).summary(
        "customer", F.col("l_returnflag") == "R", SUMMARY, SUMMARY_COUNTS
    )


@query(ORACLE["hierarchy_summary"])
def hierarchy_summary_plain(spark: SparkSession, folder: str) -> DataFrame:
    return _urgent(spark, folder).summary_plain(
        "customer", F.col("l_returnflag") == "R", SUMMARY, SUMMARY_COUNTS
    )


@query(
    """
    SELECT r_name, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT o_orderkey) AS n_orders,
           count(DISTINCT l_orderkey * 8 + l_linenumber) AS n_lines
    FROM region
    LEFT JOIN nation ON n_regionkey = r_regionkey
    LEFT JOIN customer ON c_nationkey = n_nationkey
    LEFT JOIN orders ON o_custkey = c_custkey
    LEFT JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY r_name
    """
)
def distinct_by_region(spark: SparkSession, folder: str) -> DataFrame:
    counts = {"customer": "n_customers", "orders": "n_orders", "lineitem": "n_lines"}
    summary = sales(spark, folder).summary("region", None, {"r_name": "region.r_name"}, counts)
    return summary.drop("n_nation")


@query(
    """
    SELECT n_name, count(s_suppkey) AS n_suppliers
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000
    GROUP BY n_name
    """
)
def zero_preserving(spark: SparkSession, folder: str) -> DataFrame:
    rich = table(spark, folder, "supplier").filter(F.col("s_acctbal") > 9000)
    chain = Hierarchy(
        [
            Level("nation", table(spark, folder, "nation"), "n_nationkey"),
            Level("supplier", rich, "s_suppkey", "s_nationkey"),
        ]
    )
    return chain.summary("nation", None, {"n_name": "nation.n_name"}, {"supplier": "n_suppliers"})


@query(
    """
    SELECT r_name, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_final
    FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    GROUP BY r_name
    """
)
def named_view(spark: SparkSession, folder: str) -> DataFrame:
    """A hierarchy under a name of its own, then asked in SQL."""
    register(spark, "order_tree", sales(spark, folder).children("orders"))
    return spark.sql(
        "SELECT r_name, count_if(o_orderstatus = 'F') AS n_final FROM order_tree GROUP BY r_name"
    )


# --- constraints ---------------------------------------------------------


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


@query(
    """
    SELECT 'documents' AS "table", v."constraint", 'not_null' AS kind, n_violations
    FROM (SELECT count(*) - count(quality) AS q, count(*) - count(lang) AS l
          FROM documents LEFT JOIN labels USING (doc_id)) t,
    LATERAL (VALUES ('quality', q), ('lang', l)) v("constraint", n_violations)
    """
)
def check_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return C.check_not_null(_labelled(spark, folder), ["quality", "lang"], "documents")


@query(
    """
    SELECT 'orders' AS "table", 'o_orderkey' AS "constraint", 'primary_key' AS kind,
           count(*) - count(DISTINCT o_orderkey) AS n_violations FROM orders
    UNION ALL
    SELECT 'lineitem', 'l_orderkey', 'primary_key', count(*) FROM lineitem
    WHERE l_orderkey IS NULL OR l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
    """
)
def check_pk(spark: SparkSession, folder: str) -> DataFrame:
    clean = C.check_primary_key(table(spark, folder, "orders"), "o_orderkey", "orders")
    return clean.unionByName(C.check_primary_key(table(spark, folder, "lineitem"), "l_orderkey", "lineitem"))


@query("SELECT p_name, count(*) AS n_rows FROM part GROUP BY p_name HAVING count(*) > 1")
def check_unique_single(spark: SparkSession, folder: str) -> DataFrame:
    return C.duplicate_keys(table(spark, folder, "part"), "p_name")


@query(
    """
    SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    """
)
def check_unique_composite(spark: SparkSession, folder: str) -> DataFrame:
    repeated = C.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])
    return repeated.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1
    """
)
def offending_unique(spark: SparkSession, folder: str) -> DataFrame:
    rule = C.UniqueRule(("l_orderkey", "l_linenumber"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return C.offending_rows(lines, rule)


@query(
    """
    SELECT 'part' AS "table", 'p_size 1..8' AS "constraint", 'check' AS kind,
           count(*) FILTER (WHERE p_size < 1 OR p_size > 8) AS n_violations FROM part
    """
)
def check_between(spark: SparkSession, folder: str) -> DataFrame:
    return C.check(table(spark, folder, "part"), F.col("p_size").between(1, 8), "p_size 1..8", "part")


@query(
    """
    SELECT 'part' AS "table", 'p_type listed' AS "constraint", 'check' AS kind, count(*) AS n_violations
    FROM part WHERE p_type <> 'ECONOMY' AND p_type <> 'SMALL'
    """
)
def check_in(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.col("p_type").isin("ECONOMY", "SMALL")
    return C.check(table(spark, folder, "part"), listed, "p_type listed", "part")


@query(
    """
    SELECT 'orders' AS "table", 'o_custkey->customer' AS "constraint", 'foreign_key' AS kind, count(*) AS n_violations
    FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_mktsegment = 'BUILDING')
    """
)
def check_fk(spark: SparkSession, folder: str) -> DataFrame:
    building = table(spark, folder, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    orders = table(spark, folder, "orders")
    return C.check_foreign_key(orders, "o_custkey", building, "c_custkey", "orders", "customer")


@query(
    """
    SELECT o_orderkey, o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'
    WHERE c_custkey IS NULL AND o_custkey IS NOT NULL
    """
)
def offending_fk(spark: SparkSession, folder: str) -> DataFrame:
    building = table(spark, folder, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    key = ForeignKey(("o_custkey",), "customer", ("c_custkey",))
    return C.offending_rows(table(spark, folder, "orders"), key, building).select("o_orderkey", "o_custkey")


@query(
    """
    SELECT 'events' AS "table", 'event_type' AS "constraint", 'domain' AS kind, count(*) AS n_violations
    FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')
    """
)
def check_domain(spark: SparkSession, folder: str) -> DataFrame:
    return C.check_domain(table(spark, folder, "events"), "event_type", EVENT, "events")


@query(
    """
    SELECT 'documents' AS "table", 'text' AS "constraint", 'length' AS kind, count(*) AS n_violations
    FROM documents WHERE length(rtrim(text, ' ')) > 255
    """
)
def check_length(spark: SparkSession, folder: str) -> DataFrame:
    return C.check_length(table(spark, folder, "documents"), "text", 255, "documents")


@query(
    """
    SELECT 'lineitem' AS "table", 'l_extendedprice' AS "constraint", 'numeric' AS kind, count(*) AS n_violations
    FROM lineitem WHERE abs(round(l_extendedprice, 1)) >= 10000
    """
)
def check_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return C.check_numeric(table(spark, folder, "lineitem"), "l_extendedprice", 5, 1, "lineitem")


@query(
    """
    SELECT 'events' AS "table", 'value' AS "constraint", 'type' AS kind, count(*) AS n_violations
    FROM (SELECT json_extract_string(props, '$.k') AS value FROM events)
    WHERE value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL
    UNION ALL
    SELECT 'events', 'user_id', 'type', count(*) FROM events
    WHERE event_type IS NOT NULL AND TRY_CAST(event_type AS BIGINT) IS NULL
    """
)
def check_type(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "events").select(
        F.get_json_object("props", "$.k").alias("value"), F.col("event_type").alias("user_id")
    )
    lines = C.validate_raw(raw, STAR["events"])
    return lines.filter(F.col("constraint").isin("value", "user_id"))


def _star(spark: SparkSession, folder: str, *names: str) -> tuple[dict[str, DataFrame], list[TableSpec]]:
    return {n: table(spark, folder, n) for n in names}, [STAR[n] for n in names]


def _sql_audit(*names: str) -> str:
    """Every declared constraint of the named tables as SQL, one SELECT each."""
    return "\nUNION ALL\n".join(line for n in names for line in sql_audit_lines(STAR[n]))


_SQL_CHECKS = {
    "p_size 1..8": "p_size NOT BETWEEN 1 AND 8",
    "p_type listed": "p_type NOT IN ('ECONOMY', 'SMALL')",
    "semester_number 1..8": "semester_number NOT BETWEEN 1 AND 8",
    "year_number 1..4": "year_number NOT BETWEEN 1 AND 4",
    "semester_number 7 or 8": "semester_number NOT IN (7, 8)",
}


def sql_audit_lines(spec: TableSpec) -> list[str]:
    def line(constraint: str, kind: str, where: str) -> str:
        return (
            f"SELECT '{spec.name}' AS \"table\", '{constraint}' AS \"constraint\", '{kind}' AS kind, "
            f"count(*) AS n_violations FROM {spec.name} t WHERE {where}"
        )

    def repeated(columns: tuple[str, ...]) -> str:
        keys = ", ".join(columns)
        return f"({keys}) IN (SELECT ({keys}) FROM {spec.name} GROUP BY {keys} HAVING count(*) > 1)"

    lines = []
    for c in spec.columns:
        if c.required:
            lines.append(line(c.name, "not_null", f"{c.name} IS NULL"))
        if c.max_length is not None:
            lines.append(line(c.name, "length", f"length(rtrim({c.name}, ' ')) > {c.max_length}"))
        if c.domain is not None:
            lines.append(line(c.name, "domain", f"{c.name} NOT IN {c.domain.values}"))
    lines += [line(c.name, "check", _SQL_CHECKS[c.name]) for c in spec.checks]
    if spec.primary_key:
        lines.append(line(",".join(spec.primary_key), "primary_key", repeated(spec.primary_key)))
    lines += [line(",".join(u), "unique", repeated(u)) for u in spec.unique]
    for k in spec.foreign_keys:
        (child,), (parent,) = k.columns, k.parent_columns
        absent = f"NOT EXISTS (SELECT 1 FROM {k.parent} p WHERE p.{parent} = t.{child})"
        lines.append(line(f"{child}->{k.parent}", "foreign_key", f"t.{child} IS NOT NULL AND {absent}"))
    return lines


AUDITED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


@query(_sql_audit(*AUDITED))
def validate_report(spark: SparkSession, folder: str) -> DataFrame:
    return C.validate(*_star(spark, folder, *AUDITED))


# --- cascade -------------------------------------------------------------


def _cascade(spark: SparkSession, folder: str) -> Cascade:
    tables, specs = _star(spark, folder, "region", "nation", "customer", "supplier", "orders", "lineitem")
    keys = {s.name: [k for k in s.foreign_keys if k.parent in tables] for s in specs}
    return cascade_delete(tables, keys, "region", F.col("r_name") == "ASIA", durable=True)


_SQL_DOOMED = """
    WITH n AS (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'),
    c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)),
    s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)),
    o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))
"""


@query("SELECT 'customer' AS \"table\", count(*) AS n_deleted FROM customer WHERE c_mktsegment = 'BUILDING'")
def cascade_lone_root(spark: SparkSession, folder: str) -> DataFrame:
    """A table that nothing refers to."""
    customers = {"customer": table(spark, folder, "customer")}
    return cascade_delete(customers, {}, "customer", F.col("c_mktsegment") == "BUILDING").counts()


@query(
    _SQL_DOOMED
    + """
    SELECT 'region' AS "table", count(*) AS n_deleted FROM region WHERE r_name = 'ASIA'
    UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'customer', count(*) FROM c
    UNION ALL SELECT 'supplier', count(*) FROM s UNION ALL SELECT 'orders', count(*) FROM o
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (FROM o) OR l_suppkey IN (FROM s)
    """,
    name="cascade_delete",
)
def cascade_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _cascade(spark, folder).counts()


@query(
    _SQL_DOOMED
    + """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_orderkey IN (FROM o) OR l_suppkey IN (FROM s)
    """
)
def cascade_deleted(spark: SparkSession, folder: str) -> DataFrame:
    deleted = _cascade(spark, folder).deleted["lineitem"]
    return deleted.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    _SQL_DOOMED
    + """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_orderkey NOT IN (FROM o) AND l_suppkey NOT IN (FROM s)
    """
)
def cascade_surviving(spark: SparkSession, folder: str) -> DataFrame:
    kept = _cascade(spark, folder).surviving["lineitem"]
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# --- types and columns ---------------------------------------------------


@query(
    """
    SELECT CAST(min(p) AS DOUBLE) AS low, CAST(max(p) AS DOUBLE) AS high, CAST(sum(p) AS DOUBLE) AS total
    FROM (SELECT CAST(l_extendedprice AS DECIMAL(12, 1)) AS p FROM lineitem)
    """
)
def decimal_cast(spark: SparkSession, folder: str) -> DataFrame:
    price = table(spark, folder, "lineitem").select(to_numeric(F.col("l_extendedprice"), 12, 1).alias("p"))
    return price.agg(
        F.min("p").cast("double").alias("low"),
        F.max("p").cast("double").alias("high"),
        F.sum("p").cast("double").alias("total"),
    )


@query(
    """
    SELECT c_custkey, c_mktsegment || repeat(' ', 10 - length(c_mktsegment)) AS padded
    FROM customer
    """
)
def varchar_cast(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen characters fit ten if the excess is spaces."""
    padded = F.rpad("c_mktsegment", 15, " ")
    return table(spark, folder, "customer").select("c_custkey", to_varchar(padded, 10).alias("padded"))


@query(
    """
    SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', 2) AS second_word,
           CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n_words
    FROM part
    """
)
def array_project(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return words.select(
        "p_partkey",
        F.get("words", F.lit(0)).alias("first_word"),
        F.get("words", F.lit(1)).alias("second_word"),
        F.size("words").alias("n_words"),
    )


@query(
    """
    SELECT CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
                WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS INTEGER) AS priority_rank,
           o_orderpriority, count(*) AS n_orders
    FROM orders GROUP BY 1, 2
    """
)
def domain_order(spark: SparkSession, folder: str) -> DataFrame:
    ranked = table(spark, folder, "orders").withColumn("priority_rank", PRIORITY.rank(F.col("o_orderpriority")))
    counted = ranked.groupBy("priority_rank", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))
    return counted.orderBy(F.col("priority_rank").asc_nulls_last())


@query(
    """
    SELECT event_id, strftime(ts - INTERVAL '5 hours 30 minutes', '%Y-%m-%d %H:%M:%S') AS utc,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS wall_time
    FROM events
    """,
    name="to_utc",
)
def to_utc_instant(spark: SparkSession, folder: str) -> DataFrame:
    """Readings taken in a zone 5:30 ahead of UTC all year."""
    events = table(spark, folder, "events")
    return events.select(
        "event_id", _stamp(to_utc(F.col("ts"), "Asia/Kolkata")).alias("utc"), _stamp(F.col("ts")).alias("wall_time")
    )


# --- scans and filters ---------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'", name="lookup")
def lookup_two_columns(spark: SparkSession, folder: str) -> DataFrame:
    found = lookup(table(spark, folder, "orders"), {"o_custkey": 7, "o_orderstatus": "F"})
    return found.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(ORACLE["lookup"])
def lookup_after_clustering(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    path = _stored(orders, "orders-clustered")
    write_clustered(orders, path, sort_by=["o_custkey", "o_orderkey"], partition_by="o_orderstatus")
    found = lookup(scan(spark, path, STAR["orders"]), {"o_custkey": 7, "o_orderstatus": "F"})
    return found.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    """
    SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY o_orderkey
    """
)
def bucketed_children(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and lines share buckets on the order key: no exchange for the join
    or the count."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    path = _stored(orders, "bucketed")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = path.rsplit("-", 1)[1]
    orders = write_bucketed(orders, f"orders_{tag}", f"{path}/orders", "o_orderkey", buckets)
    lines = write_bucketed(lines, f"lines_{tag}", f"{path}/lines", "l_orderkey", buckets)
    joined = lines.hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def flagged_subset(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    path = _stored(lines, "flagged")
    write_subset(lines, F.col("l_returnflag") == "R", path)
    return scan(spark, path, STAR["lineitem"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    """
    SELECT 'segment' AS policy, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_visible FROM customer
    UNION ALL SELECT 'open', count(*) FROM customer
    UNION ALL SELECT 'none', 0
    UNION ALL SELECT 'either', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3
    """
)
def row_policy(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    building, nation = F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") == 3
    seen = {
        "segment": apply_policy(customers, building),
        "open": apply_policy(customers, True),
        "none": apply_policy(customers),
        "either": apply_policy(customers, building, nation),
    }
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_visible")).select(F.lit(name).alias("policy"), "n_visible")
        for name, df in seen.items()
    ]
    first, *rest = counts
    for other in rest:
        first = first.unionByName(other)
    return first


# --- ingest and maintenance ----------------------------------------------

_AS_OF = dt.datetime(2024, 1, 2, 3, 4, 5)

VENDOR = TableSpec(
    "vendor",
    (
        Declared("id", T.LongType(), required=True, generated=True),
        Declared("s_suppkey", T.LongType(), required=True),
        Declared("s_name", T.StringType(), required=True, max_length=30),
        Declared("s_nationkey", T.IntegerType(), required=True),
        Declared("degree", T.StringType(), default="standard", max_length=50),
        Declared("hours", T.IntegerType(), default=3),
        Declared("approved", T.BooleanType(), default=False),
        Declared("notes", T.ArrayType(T.StringType())),
        Declared("created_at", T.TimestampType(), required=True, default=lambda now: now),
    ),
    primary_key=("id",),
)


@query(
    """
    SELECT s_suppkey, s_name, s_nationkey, NULL::VARCHAR AS degree, 3 AS hours, FALSE AS approved,
           TRUE AS no_notes, '2024-01-02 03:04:05' AS created_at
    FROM supplier
    """
)
def conform_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """`hours`, `approved`, `notes` and `created_at` are absent; `degree` is an explicit NULL."""
    given = table(spark, folder, "supplier").drop("s_acctbal").withColumn("degree", F.lit(None).cast("string"))
    rows = conform(given, VENDOR, _AS_OF)
    return rows.withColumn("no_notes", F.col("notes").isNull()).withColumn(
        "created_at", _stamp(F.col("created_at"))
    ).drop("notes")


@query(
    """
    SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey,
           strftime(o_orderdate, '%Y-%m-%d') AS day
    FROM orders
    """
)
def surrogate_keys(spark: SparkSession, folder: str) -> DataFrame:
    keyed = assign_keys(table(spark, folder, "orders"), ["o_orderdate", "o_orderkey"])
    return keyed.select("id", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(
    """
    WITH first AS (SELECT s_suppkey + 1 AS id, s_suppkey FROM supplier),
    more AS (SELECT (SELECT max(id) FROM first) + row_number() OVER (ORDER BY c_custkey) AS id, c_custkey FROM customer)
    SELECT * FROM first UNION ALL SELECT * FROM more
    """
)
def append_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Explicit ids first, then a batch numbered after the highest of them."""
    first = table(spark, folder, "supplier").drop("s_acctbal").withColumn("id", F.col("s_suppkey") + 1)
    path = _stored(first, "vendors")
    write_table(conform(first, VENDOR, _AS_OF), path)
    batch = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_nationkey").alias("s_nationkey")
    )
    start = last_key(scan(spark, path, VENDOR))
    append_rows(assign_keys(batch, "s_suppkey", start), VENDOR, path, _AS_OF)
    return scan(spark, path, VENDOR).select("id", "s_suppkey")


_LISTED = replace(
    VENDOR,
    name="listed",
    unique=(("s_suppkey",),),
    foreign_keys=(ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),),
)


def _as_vendors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_nationkey").alias("s_nationkey")
    )


def _sql_findings(**counts: str) -> str:
    """Report lines of `_LISTED`; `counts` maps a kind to the rows that break it."""
    lines = [(c, "not_null") for c in ("id", "s_suppkey", "s_name", "s_nationkey", "created_at")]
    lines += [("s_name", "length"), ("degree", "length"), ("id", "primary_key"), ("s_suppkey", "unique")]
    lines.append(("s_nationkey->nation", "foreign_key"))
    return "\nUNION ALL\n".join(
        f"""SELECT 'listed' AS "table", '{name}' AS "constraint", '{kind}' AS kind, {counts.get(kind, "0")}::BIGINT AS n_violations"""
        for name, kind in lines
    )


@query(
    _sql_findings(
        primary_key="(SELECT count(*) FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier))",
        unique="(SELECT count(*) FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier))",
        foreign_key="(SELECT count(*) FROM customer WHERE c_nationkey = 3)",
    )
)
def append_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Customers come as vendors under keys that suppliers hold; one nation is unknown."""
    nations = table(spark, folder, "nation")
    first = table(spark, folder, "supplier").drop("s_acctbal").withColumn("id", F.col("s_suppkey") + 1)
    path = fresh_path(spark, "listed")
    add_checked(first, _LISTED, path, {"nation": nations}, as_of=_AS_OF)
    more = _as_vendors(spark, folder).withColumn("id", F.col("s_suppkey") + 1)
    return add_checked(more, _LISTED, path, {"nation": nations.filter("n_nationkey <> 3")}, as_of=_AS_OF).audit


@query(ORACLE["append_batch"])
def append_generated(spark: SparkSession, folder: str) -> DataFrame:
    """The second batch comes without ids and is numbered after the first."""
    first = table(spark, folder, "supplier").drop("s_acctbal").withColumn("id", F.col("s_suppkey") + 1)
    path = fresh_path(spark, "vendors")
    add_checked(first, VENDOR, path, as_of=_AS_OF)
    add_checked(_as_vendors(spark, folder), VENDOR, path, order_by="s_suppkey", as_of=_AS_OF)
    return scan(spark, path, VENDOR).select("id", "s_suppkey")


_PRICED = TableSpec("priced", tuple(Declared(c, T.IntegerType()) for c in ("orderkey", "linenumber", "price")))


@query(
    """
    SELECT CAST(l_orderkey AS INTEGER) AS orderkey, l_linenumber AS linenumber,
           CAST(floor(l_extendedprice + 0.5) AS INTEGER) AS price
    FROM lineitem
    """
)
def integer_cast(spark: SparkSession, folder: str) -> DataFrame:
    """Fractions load into whole numbers half up."""
    lines = table(spark, folder, "lineitem")
    return conform(lines.select(*[F.col(f"l_{c}").alias(c) for c in ("orderkey", "linenumber")], F.col("l_extendedprice").alias("price")), _PRICED)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def rebuild_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same load twice leaves the content of one."""
    suppliers = table(spark, folder, "supplier")
    path = _stored(suppliers, "rebuilt")
    for _ in range(2):
        write_table(suppliers, path)
    return scan(spark, path, STAR["supplier"]).select("s_suppkey", "s_name", "s_acctbal")


_BATCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query(_sql_audit(*_BATCH))
def publish_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of a batch that repeats keys, so it is never committed."""
    tables, specs = _star(spark, folder, *_BATCH)
    return publish(spark, tables, specs, fresh_path(spark, "published")).audit


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def publish_and_read(spark: SparkSession, folder: str) -> DataFrame:
    tables, specs = _star(spark, folder, "region", "nation", "customer", "orders")
    target = fresh_path(spark, "published")
    publish(spark, tables, specs, target)
    return read_published(spark, target, STAR["orders"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def publish_two_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Parents first, children in a batch of their own; then the roots once more."""
    tables, _ = _star(spark, folder, "region", "nation", "customer")
    target = fresh_path(spark, "published")

    def read(name: str) -> DataFrame:
        return read_published(spark, target, STAR[name])

    publish(spark, {n: tables[n] for n in ("region", "nation")}, [STAR["region"], STAR["nation"]], target)
    publish(spark, {"customer": tables["customer"]}, [STAR["customer"]], target, {"nation": read("nation")})
    publish(spark, {"region": tables["region"]}, [STAR["region"]], target)
    customers = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("WITH nation AS (SELECT * FROM main.nation WHERE n_nationkey <> 3)" + _sql_audit("customer"))
def publish_child_only(spark: SparkSession, folder: str) -> DataFrame:
    """Children against published parents, of which one is missing."""
    tables, _ = _star(spark, folder, "region", "nation", "customer")
    target = fresh_path(spark, "published")
    parents = {"region": tables["region"], "nation": tables["nation"].filter("n_nationkey <> 3")}
    publish(spark, parents, [STAR["region"], STAR["nation"]], target)
    known = {"nation": read_published(spark, target, STAR["nation"])}
    return publish(spark, {"customer": tables["customer"]}, [STAR["customer"]], target, known).audit


@query(
    """
    SELECT 'orders' AS "table", 'price' AS "constraint", 'unknown_column' AS kind, 1::BIGINT AS n_violations
    UNION ALL SELECT 'orders', 'o_custkey', 'type', count(*) FROM orders WHERE o_orderstatus = 'P'
    """
)
def publish_misnamed(spark: SparkSession, folder: str) -> DataFrame:
    """A column under a wrong name and keys that aren't numbers: findings, no commit."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_totalprice", "price")
    key = F.when(F.col("o_orderstatus") == "P", "none").otherwise(F.col("o_custkey").cast("string"))
    done = publish(spark, {"orders": orders.withColumn("o_custkey", key)}, [STAR["orders"]], fresh_path(spark, "published"))
    return done.audit


# --- trigrams ------------------------------------------------------------

_SQL_NAMES = f"names AS (SELECT p_name, {sql_trigrams('p_name')} AS t FROM (SELECT DISTINCT p_name FROM part))"


def _sql_wanted(text: str) -> str:
    return f"wanted AS (SELECT {sql_trigrams(repr(text))} AS w)"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """The test tables are kept in one file each, so their rows are dealt out."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"), 2 * spark.sparkContext.defaultParallelism)


@query(f"SELECT doc_id, CAST(len({sql_trigrams('text')}) AS INTEGER) AS n_trigrams FROM documents")
def trigram_count(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    return texts.select("doc_id", F.size(trigrams(F.col("text"))).alias("n_trigrams"))


@query(
    f"""
    WITH {_SQL_NAMES}, {_sql_wanted('red wigdet')}
    SELECT p_name, CAST(len(list_intersect(t, w)) AS INTEGER) AS shared,
           CAST(len(list_distinct(t || w)) AS INTEGER) AS combined,
           round(len(list_intersect(t, w)) / len(list_distinct(t || w)), 6) AS similarity
    FROM names, wanted
    """
)
def trigram_similarity(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_name").distinct()
    sets = with_once(names, own=trigrams(F.col("p_name")), other=trigrams(F.lit("red wigdet")))
    own, other = F.col("own"), F.col("other")
    return (
        with_once(sets, shared=shared(own, other))
        .withColumn("combined", combined(own, other, F.col("shared")))
        .withColumn("similarity", F.round(ratio(F.col("shared"), F.col("combined")), 6))
        .drop("own", "other")
    )


_SQL_FUZZY = f"""
    WITH {_SQL_NAMES}, {_sql_wanted('red wid')},
    scored AS (
      SELECT p_name, len(list_intersect(t, w)) AS s, len(list_distinct(t || w)) AS c FROM names, wanted)
    SELECT p_name, CAST(s AS INTEGER) AS shared, CAST(c AS INTEGER) AS combined FROM scored WHERE s * 10 >= c * 3
"""


@query(_SQL_FUZZY, name="fuzzy_search")
def fuzzy_titles(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_name").distinct()
    return fuzzy_search(names, "p_name", "red wid")


@query(
    f"""
    WITH {_sql_wanted('the on that')},
    scored AS (
      SELECT doc_id, len(list_intersect(t, w)) AS s, len(t) + len(w) AS n
      FROM (SELECT doc_id, {sql_trigrams('text')} AS t FROM documents), wanted)
    SELECT doc_id, CAST(s AS INTEGER) AS shared, CAST(n - s AS INTEGER) AS combined
    FROM scored WHERE s > 0 AND s * 20 >= n - s
    """
)
def fuzzy_texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    return fuzzy_search(texts, "text", "the on that", Threshold(1, 20)).drop("text")


@query(_SQL_FUZZY)
def fuzzy_titles_indexed(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_name").distinct()
    path = _stored(names, "title-index")
    write_index(trigram_index(names, "p_name", "p_name"), "p_name", path)
    return index_search(spark.read.schema(_INDEX).parquet(path), "p_name", "red wid")


_INDEX = T.StructType(
    [
        T.StructField("trigram", T.StringType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("set_size", T.IntegerType()),
    ]
)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%IDGE%'", name="pattern_search")
def pattern_titles(spark: SparkSession, folder: str) -> DataFrame:
    return pattern_search(table(spark, folder, "part"), "p_name", "%IDGE%").select("p_partkey", "p_name")


@query(ORACLE["pattern_search"])
def pattern_titles_indexed(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    path = _stored(parts, "part-index")
    write_index(trigram_index(parts, "p_partkey", "p_name"), "p_partkey", path)
    index = spark.read.parquet(path)
    return index_pattern_search(index, parts, "p_partkey", "p_name", "%IDGE%")


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%the on%'")
def pattern_texts(spark: SparkSession, folder: str) -> DataFrame:
    return pattern_search(table(spark, folder, "documents"), "text", "%the on%").select("doc_id", "lang")


@query(
    f"""
    SELECT trigram, p_partkey, CAST(n AS INTEGER) AS set_size
    FROM (SELECT p_partkey, unnest(t) AS trigram, len(t) AS n
          FROM (SELECT p_partkey, {sql_trigrams('p_name')} AS t FROM part))
    """,
    name="trigram_index",
)
def title_postings(spark: SparkSession, folder: str) -> DataFrame:
    return trigram_index(table(spark, folder, "part"), "p_partkey", "p_name")


def _sql_pairs(left: str, right: str, over: int, under: int, order: str) -> str:
    return f"""
    WITH l AS (SELECT title, len(t) AS n, unnest(t) AS g FROM (SELECT title, {sql_trigrams('title')} AS t FROM ({left}))),
    r AS (SELECT title, len(t) AS n, unnest(t) AS g FROM (SELECT title, {sql_trigrams('title')} AS t FROM ({right}))),
    scored AS (
      SELECT l.title AS left_title, r.title AS right_title, count(*) AS s, any_value(l.n + r.n) AS n
      FROM l JOIN r ON l.g = r.g AND {order} AND l.n * {over} <= r.n * {under} AND r.n * {over} <= l.n * {under}
      GROUP BY l.title, r.title)
    SELECT left_title, right_title, CAST(s AS INTEGER) AS shared, CAST(n - s AS INTEGER) AS combined
    FROM scored WHERE s * {under} >= (n - s) * {over}
    """


_SQL_P_NAME = "SELECT DISTINCT p_name AS title FROM part"
_SQL_P_LONG = "SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type AS title FROM part"


@query(_sql_pairs(_SQL_P_NAME, _SQL_P_NAME, 1, 2, "l.title < r.title"), name="similarity_join")
def similar_titles(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_self_join(table(spark, folder, "part"), "p_name", Threshold(1, 2))


@query(_sql_pairs(_SQL_P_LONG, _SQL_P_LONG, 4, 5, "l.title < r.title"))
def similar_long_titles(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    return similarity_self_join(parts, "title", Threshold(4, 5))


@query(_sql_pairs(_SQL_P_NAME, "SELECT DISTINCT p_name || ' ' || p_type AS title FROM part", 1, 2, "TRUE"))
def similar_across(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    names = parts.select(F.col("p_name").alias("title"))
    typed = parts.select(F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return similarity_join(names, typed, "title", Threshold(1, 2))


@query(ORACLE["similarity_join"])
def similar_titles_crowded(spark: SparkSession, folder: str) -> DataFrame:
    """As `similarity_join`, with crowds refined early."""
    return similarity_self_join(table(spark, folder, "part"), "p_name", Threshold(1, 2), crowd=50)


@query(
    f"""
    WITH titles AS (SELECT DISTINCT unnest([p_name || ' ' || p_type, p_type || ' ' || p_name]) AS title FROM part),
    named AS (SELECT title, list_sort({sql_trigrams('title')}) AS t FROM titles),
    classes AS (SELECT t, min(title) AS class_title FROM named GROUP BY t),
    grams AS (SELECT class_title, len(t) AS n, unnest(t) AS g FROM classes),
    pairs AS (
      SELECT l.class_title AS class_title, r.class_title AS other
      FROM grams l JOIN grams r ON l.g = r.g AND l.class_title <> r.class_title
      GROUP BY l.class_title, r.class_title HAVING count(*) * 5 >= (any_value(l.n + r.n) - count(*)) * 4),
    numbers AS (SELECT class_title, count(*) AS n_links FROM pairs GROUP BY class_title)
    SELECT title, class_title, coalesce(n_links, 0)::BIGINT AS n_links
    FROM named JOIN classes USING (t) LEFT JOIN numbers USING (class_title)
    """
)
def similar_title_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Compact form: titles of one set stay a group, links are counted between sets."""
    parts = table(spark, folder, "part")
    orders = F.array(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_name"))
    titles = parts.select(F.explode(orders).alias("title"))
    return similar_sets(titles, None, "title", Threshold(4, 5)).classes().drop("side")
