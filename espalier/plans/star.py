"""Declared schemas of the star-schema tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.operators.hierarchy import Hierarchy, Level
from espalier.session import pin
from espalier.sources.ingest import scan
from espalier.spec import Check, Column, Domain, ForeignKey, TableSpec

LONG, INT, TEXT, REAL, TIME = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.DoubleType(),
    T.TimestampType(),
)

PRIORITY = Domain("priority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
EVENT = Domain("event", ("click", "view", "purchase", "signup"))


def _fk(column: str, parent: str, key: str) -> ForeignKey:
    return ForeignKey((column,), parent, (key,))


REGION = TableSpec(
    "region",
    (Column("r_regionkey", INT, required=True), Column("r_name", TEXT, required=True, max_length=20)),
    primary_key=("r_regionkey",),
    unique=(("r_name",),),
)
NATION = TableSpec(
    "nation",
    (
        Column("n_nationkey", INT, required=True),
        Column("n_name", TEXT, required=True, max_length=20),
        Column("n_regionkey", INT, required=True),
    ),
    primary_key=("n_nationkey",),
    unique=(("n_regionkey", "n_name"),),
    foreign_keys=(_fk("n_regionkey", "region", "r_regionkey"),),
)
CUSTOMER = TableSpec(
    "customer",
    (
        Column("c_custkey", LONG, required=True),
        Column("c_name", TEXT, required=True, max_length=30),
        Column("c_nationkey", INT, required=True),
        Column("c_acctbal", REAL),
        Column("c_mktsegment", TEXT, max_length=10),
    ),
    primary_key=("c_custkey",),
    foreign_keys=(_fk("c_nationkey", "nation", "n_nationkey"),),
)
SUPPLIER = TableSpec(
    "supplier",
    (
        Column("s_suppkey", LONG, required=True),
        Column("s_name", TEXT, required=True, max_length=30),
        Column("s_nationkey", INT, required=True),
        Column("s_acctbal", REAL),
    ),
    primary_key=("s_suppkey",),
    foreign_keys=(_fk("s_nationkey", "nation", "n_nationkey"),),
)
PART = TableSpec(
    "part",
    (
        Column("p_partkey", LONG, required=True),
        Column("p_name", TEXT, required=True, max_length=255),
        Column("p_brand", TEXT),
        Column("p_type", TEXT),
        Column("p_size", INT),
        Column("p_retailprice", REAL),
    ),
    primary_key=("p_partkey",),
    unique=(("p_name",),),
    checks=(
        Check("p_size 1..8", lambda: F.col("p_size").between(1, 8)),
        Check("p_type listed", lambda: F.col("p_type").isin("ECONOMY", "SMALL")),
    ),
)
ORDERS = TableSpec(
    "orders",
    (
        Column("o_orderkey", LONG, required=True),
        Column("o_custkey", LONG, required=True),
        Column("o_orderstatus", TEXT, max_length=1),
        Column("o_totalprice", REAL),
        Column("o_orderdate", TIME),
        Column("o_orderpriority", TEXT, domain=PRIORITY),
    ),
    primary_key=("o_orderkey",),
    foreign_keys=(_fk("o_custkey", "customer", "c_custkey"),),
)
LINEITEM = TableSpec(
    "lineitem",
    (
        Column("l_orderkey", LONG, required=True),
        Column("l_partkey", LONG, required=True),
        Column("l_suppkey", LONG, required=True),
        Column("l_linenumber", INT, required=True),
        Column("l_quantity", REAL),
        Column("l_extendedprice", REAL),
        Column("l_discount", REAL),
        Column("l_tax", REAL),
        Column("l_returnflag", TEXT, max_length=1),
        Column("l_linestatus", TEXT, max_length=1),
        Column("l_shipdate", TIME),
    ),
    primary_key=("l_orderkey", "l_linenumber"),
    foreign_keys=(
        _fk("l_orderkey", "orders", "o_orderkey"),
        _fk("l_suppkey", "supplier", "s_suppkey"),
        _fk("l_partkey", "part", "p_partkey"),
    ),
)
EVENTS = TableSpec(
    "events",
    (
        Column("event_id", LONG, required=True),
        Column("ts", TIME, required=True),
        Column("user_id", LONG),
        Column("event_type", TEXT, domain=EVENT),
        Column("value", REAL),
        Column("props", TEXT),
    ),
    primary_key=("event_id",),
)
DOCUMENTS = TableSpec(
    "documents",
    (
        Column("doc_id", LONG, required=True),
        Column("text", TEXT, max_length=255),
        Column("lang", TEXT),
        Column("source", TEXT),
        Column("n_chars", LONG),
    ),
    primary_key=("doc_id",),
)
LABELS = TableSpec(
    "labels",
    (Column("doc_id", LONG, required=True), Column("quality", INT), Column("toxic", INT)),
    primary_key=("doc_id",),
    foreign_keys=(_fk("doc_id", "documents", "doc_id"),),
)

STAR = {
    s.name: s
    for s in (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS, DOCUMENTS, LABELS)
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return scan(pin(spark), f"{folder}/{name}.parquet", STAR[name])


def sales(
    spark: SparkSession,
    folder: str,
    orders: DataFrame | None = None,
    lineitem: DataFrame | None = None,
) -> Hierarchy:
    """region > nation > customer > orders > lineitem."""

    def get(name: str) -> DataFrame:
        return table(spark, folder, name)

    return Hierarchy(
        [
            Level("region", get("region"), "r_regionkey"),
            Level("nation", get("nation"), "n_nationkey", "n_regionkey"),
            Level("customer", get("customer"), "c_custkey", "c_nationkey"),
            Level("orders", get("orders") if orders is None else orders, "o_orderkey", "o_custkey"),
            Level(
                "lineitem",
                get("lineitem") if lineitem is None else lineitem,
                ("l_orderkey", "l_linenumber"),
                "l_orderkey",
                unique=False,
            ),
        ]
    )
