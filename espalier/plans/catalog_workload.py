"""The catalogue's questions over tables derived from the star schema.

region gives the branches, nation the semesters, customer the courses, every
order a unit, an experiment and a book, every line a topic, and every part an
elective; parts of other sizes than 7 and 8 break a rule, which the audit shows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from espalier.operators.keys import assign_keys
from espalier.plans.catalog import CATEGORY, DELIVERY, FREQUENCY, IMPORTANCE, Catalog, catalog_specs
from espalier.plans.star import table
from espalier.plans.workload import query, sql_audit_lines, sql_trigrams
from espalier.sources.ingest import conform
from espalier.spec import Domain

_AS_OF = dt.datetime(2024, 1, 2, 3, 4, 5)
SPECS = catalog_specs("Example University")


def _one_of(domain: Domain, number: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in domain.values]), (F.col(number) % len(domain.values)).cast("int"))


_TOPIC_ORDER = ["unit_id", "topic_title", "exam_tips", "importance_level", "is_high_yield"]


def derive(spark: SparkSession, folder: str, numbered: bool = False) -> Catalog:
    """The catalogue over the tables of `folder`; building it starts no job.

    Topics have ids that tell them apart. `numbered` gives them the dense ids of
    a load, which sorts and stores every topic, for questions that show ids.
    """

    def get(name: str) -> DataFrame:
        return table(spark, folder, name)

    nations = get("nation").join(get("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = get("orders")
    parts = get("part").select("p_partkey", "p_name", "p_brand")
    lines = get("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    topics = lines.select(
        F.col("l_orderkey").alias("unit_id"),
        F.concat_ws(" ", "p_name", F.col("l_partkey").cast("string")).alias("topic_title"),
        F.col("p_brand").alias("topic_description"),
        # Unknown for one line status, so that a flag may be NULL.
        F.when(F.col("l_linestatus") == "O", F.col("l_returnflag") == "R").alias("is_high_yield"),
        _one_of(IMPORTANCE, "l_linenumber").alias("importance_level"),
        _one_of(FREQUENCY, "l_linenumber").alias("exam_frequency"),
        F.split("p_name", " ").alias("key_concepts"),
        F.col("l_suppkey").cast("string").alias("exam_tips"),
    )
    raw = {
        "branches": get("region").select(
            F.col("r_name").alias("id"),
            F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"),
            F.concat(F.lit("Faculty of "), "r_name").alias("name"),
            F.lit("2024-25").alias("effective_session"),
        ),
        "semesters": nations.select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.col("r_name").alias("branch_id"),
            (F.floor(F.col("n_nationkey") / 5) + 1).cast("int").alias("semester_number"),
            (F.floor(F.col("n_nationkey") / 10) + 1).cast("int").alias("year_number"),
            F.col("n_name").alias("academic_title"),
        ),
        "courses": get("customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("id"),
            F.col("c_nationkey").cast("long").alias("semester_id"),
            F.col("r_name").alias("branch_id"),
            F.col("c_name").alias("course_code"),
            F.concat_ws(" ", "c_mktsegment", "c_name").alias("course_title"),
            _one_of(CATEGORY, "c_custkey").alias("category"),
            _one_of(DELIVERY, "c_custkey").alias("delivery_type"),
            ((F.col("c_custkey") % 9 + 1) / 2).alias("credits"),
        ),
        "course_units": orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("course_id"),
            F.col("o_orderkey").cast("int").alias("unit_number"),
            F.col("o_orderstatus").alias("unit_title"),
            (F.col("o_orderkey") % 12).cast("int").alias("lecture_hours"),
        ),
        "topics": topics,
        "lab_experiments": orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("course_id"),
            F.col("o_orderkey").cast("int").alias("experiment_number"),
            F.concat(F.lit("Experiment "), F.col("o_orderkey").cast("string")).alias("title"),
            F.col("o_orderstatus").alias("description"),
        ),
        "recommended_books": orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("course_id"),
            F.when(F.col("o_orderkey") % 2 == 0, "TEXT_BOOK").otherwise("REFERENCE_BOOK").alias("book_type"),
            F.concat(F.lit("Volume "), F.col("o_orderkey").cast("string")).alias("title"),
        ),
        "open_electives": get("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_size").alias("semester_number"),
            F.col("p_type").alias("elective_group"),
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("subject_code"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("department"),
        ),
    }
    tables = {name: conform(df, SPECS[name], _AS_OF) for name, df in raw.items()}
    topics = tables["topics"]
    ids = F.monotonically_increasing_id().alias("id")
    tables["topics"] = assign_keys(topics, _TOPIC_ORDER) if numbered else topics.select(ids, "*")
    return Catalog(tables, SPECS)


def _pick(domain: Domain, number: str) -> str:
    return f"({list(domain.values)})[1 + {number} % {len(domain.values)}]"


_SEMESTER = "CAST(n_nationkey // 5 + 1 AS INTEGER)"
_COURSE = f"""
    course AS (
      SELECT c_custkey AS course, 'Faculty of ' || r_name AS branch_name, 'R' || r_regionkey AS branch_code,
             {_SEMESTER} AS sem, CAST(n_nationkey // 10 + 1 AS INTEGER) AS year, c_name AS course_code,
             c_mktsegment || ' ' || c_name AS course_title, {_pick(CATEGORY, 'c_custkey')} AS category,
             {_pick(DELIVERY, 'c_custkey')} AS delivery_type, (c_custkey % 9 + 1) / 2.0::DOUBLE AS credits
      FROM customer, nation, region WHERE n_nationkey = c_nationkey AND r_regionkey = n_regionkey)
"""
_UNIT = "unit AS (SELECT o_orderkey AS unit, o_custkey AS course, o_orderstatus FROM orders)"
_TOPIC = f"""
    topic AS (
      SELECT row_number() OVER () AS id, l_orderkey AS unit, p_name || ' ' || l_partkey AS topic_title, p_brand, p_name,
             CASE WHEN l_linestatus = 'O' THEN l_returnflag = 'R' END AS flag,
             {_pick(IMPORTANCE, 'l_linenumber')} AS importance_level,
             {_pick(FREQUENCY, 'l_linenumber')} AS exam_frequency, l_suppkey::VARCHAR AS exam_tips
      FROM lineitem JOIN part ON p_partkey = l_partkey)
"""


@query(
    f"""
    WITH {_COURSE}, {_UNIT}, {_TOPIC}
    SELECT branch_name, branch_code, sem AS semester_number, year AS year_number, course_code, course_title,
           category AS course_category, delivery_type, credits, CAST(u.unit AS INTEGER) AS unit_number,
           o_orderstatus AS unit_title, CAST(u.unit % 12 AS INTEGER) AS unit_hours, topic_title,
           p_brand AS topic_description, flag::VARCHAR AS is_high_yield, importance_level, exam_frequency, exam_tips
    FROM unit u JOIN course USING (course) LEFT JOIN topic t ON t.unit = u.unit
    """
)
def catalog_outline(spark: SparkSession, folder: str) -> DataFrame:
    rows = derive(spark, folder).outline(ordered=True)
    return rows.withColumns({"credits": F.col("credits").cast("double"), "is_high_yield": F.col("is_high_yield").cast("string")})


@query(
    f"""
    WITH {_COURSE}, {_UNIT}, {_TOPIC}
    SELECT branch_code AS branch, sem, course_code, course_title, CAST(u.unit AS INTEGER) AS unit,
           o_orderstatus AS unit_title, topic_title, importance_level, exam_frequency, exam_tips,
           replace(p_name, ' ', '|') AS key_concepts
    FROM topic t JOIN unit u ON t.unit = u.unit JOIN course USING (course) WHERE flag
    """
)
def catalog_high_yield(spark: SparkSession, folder: str) -> DataFrame:
    rows = derive(spark, folder).high_yield_topics()
    return rows.withColumn("key_concepts", F.array_join("key_concepts", "|"))


@query(
    f"""
    WITH {_COURSE}
    SELECT branch_name, sem AS semester_number, course_code, course_title, credits,
           CAST(o_orderkey AS INTEGER) AS experiment_number, 'Experiment ' || o_orderkey AS experiment_title,
           o_orderstatus AS experiment_description, NULL::VARCHAR AS tools_used
    FROM orders JOIN course ON course = o_custkey
    """
)
def catalog_labs(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder).lab_curriculum().withColumn("credits", F.col("credits").cast("double"))


@query(
    f"""
    WITH {_COURSE}, {_UNIT}, {_TOPIC}
    SELECT branch_code AS branch, sem, course_code, course_title, category, delivery_type, credits,
           30 AS ia_marks, 70 AS ete_marks, 100 AS total_marks,
           count(DISTINCT u.unit) AS total_units, count(DISTINCT t.id) AS total_topics,
           count(DISTINCT CASE WHEN t.flag THEN t.id END) AS high_yield_topics_count
    FROM course c LEFT JOIN unit u ON u.course = c.course LEFT JOIN topic t ON t.unit = u.unit
    GROUP BY ALL
    """
)
def catalog_summary(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder).subject_summary().withColumn("credits", F.col("credits").cast("double"))


_SQL_TABLES = f"""
    WITH {_COURSE}, {_UNIT}, {_TOPIC},
    branches AS (
      SELECT r_name AS id, 'R' || r_regionkey AS code, 'Faculty of ' || r_name AS name, 'Example University' AS university,
             'B.Tech' AS degree, '2024-25' AS effective_session, now() AS created_at
      FROM region WHERE r_name <> 'ASIA'),
    semesters AS (
      SELECT n_nationkey AS id, r_name AS branch_id, {_SEMESTER} AS semester_number,
             n_nationkey // 10 + 1 AS year_number, n_name AS academic_title
      FROM nation JOIN region ON r_regionkey = n_regionkey),
    courses AS (
      SELECT course AS id, c_nationkey AS semester_id, r_name AS branch_id, course_code, course_title, category,
             delivery_type, credits, 30 AS ia_marks, 70 AS ete_marks, 100 AS total_marks, now() AS created_at
      FROM course JOIN customer ON c_custkey = course JOIN nation ON n_nationkey = c_nationkey
      JOIN region ON r_regionkey = n_regionkey),
    course_units AS (
      SELECT unit AS id, course AS course_id, unit AS unit_number, o_orderstatus AS unit_title, unit % 12 AS lecture_hours
      FROM unit),
    topics AS (
      SELECT id, unit AS unit_id, topic_title, importance_level, exam_frequency,
             now() AS created_at
      FROM topic),
    lab_experiments AS (
      SELECT o_orderkey AS id, o_custkey AS course_id, o_orderkey AS experiment_number,
             'Experiment ' || o_orderkey AS title, o_orderstatus AS description, NULL::VARCHAR AS tools_used
      FROM orders),
    recommended_books AS (
      SELECT o_orderkey AS id, o_custkey AS course_id,
             CASE WHEN o_orderkey % 2 = 0 THEN 'TEXT_BOOK' ELSE 'REFERENCE_BOOK' END AS book_type,
             'Volume ' || o_orderkey AS title, NULL::VARCHAR AS authors, NULL::VARCHAR AS publisher,
             NULL::VARCHAR AS edition_year
      FROM orders),
    open_electives AS (
      SELECT p_partkey AS id, p_size AS semester_number, p_type AS elective_group, 'P' || p_partkey AS subject_code,
             p_name AS title, p_brand AS department
      FROM part)
"""


@query(_SQL_TABLES + "\nUNION ALL\n".join(line for spec in SPECS.values() for line in sql_audit_lines(spec)))
def catalog_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every constraint of the eight tables after one branch was removed without
    its dependants: the two keys that point to it are broken, and the rule on electives."""
    whole = derive(spark, folder)
    left = whole.tables["branches"].filter(F.col("id") != "ASIA")
    return Catalog({**whole.tables, "branches": left}, SPECS).audit()


@query(
    """
    WITH c AS (SELECT c_custkey FROM customer, nation, region
               WHERE n_nationkey = c_nationkey AND r_regionkey = n_regionkey AND r_name = 'ASIA'),
    o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))
    SELECT 'branches' AS "table", 1 AS n_deleted
    UNION ALL SELECT 'semesters', count(*) FROM nation, region WHERE r_regionkey = n_regionkey AND r_name = 'ASIA'
    UNION ALL SELECT 'courses', count(*) FROM c
    UNION ALL SELECT 'course_units', count(*) FROM o
    UNION ALL SELECT 'lab_experiments', count(*) FROM o
    UNION ALL SELECT 'recommended_books', count(*) FROM o
    UNION ALL SELECT 'topics', count(*) FROM lineitem WHERE l_orderkey IN (FROM o)
    """
)
def catalog_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder).without_branches(F.col("id") == "ASIA", durable=True).counts()


@query(
    f"""
    WITH {_TOPIC}
    SELECT row_number() OVER (ORDER BY unit, topic_title, exam_tips, importance_level, flag) AS id, unit AS unit_id,
           topic_title, exam_tips, importance_level, flag::VARCHAR AS is_high_yield
    FROM topic
    """
)
def catalog_topic_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids that topics are given, next to what they are numbered by."""
    topics = derive(spark, folder, numbered=True).tables["topics"].select("id", *_TOPIC_ORDER)
    return topics.withColumn("is_high_yield", F.col("is_high_yield").cast("string"))


def _sql_similar(titles: str, text: str) -> str:
    return f"""
        WITH {_COURSE}, {_TOPIC},
        titles AS (SELECT key, title, {sql_trigrams('title')} AS t FROM ({titles})),
        wanted AS (SELECT {sql_trigrams(repr(text))} AS w),
        scored AS (SELECT key, title, len(list_intersect(t, w)) AS s, len(list_distinct(t || w)) AS c FROM titles, wanted)
        SELECT key, title, CAST(s AS INTEGER) AS shared, CAST(c AS INTEGER) AS combined FROM scored WHERE s * 10 >= c * 3
    """


@query(_sql_similar("SELECT course AS key, course_title AS title FROM course", "bulding custmer"))
def catalog_course_search(spark: SparkSession, folder: str) -> DataFrame:
    found = derive(spark, folder).search_titles("courses", "bulding custmer")
    return found.select(F.col("id").alias("key"), F.col("course_title").alias("title"), "shared", "combined")


@query(_sql_similar("SELECT unit AS key, topic_title AS title FROM topic", "red wigdet"))
def catalog_topic_search(spark: SparkSession, folder: str) -> DataFrame:
    found = derive(spark, folder).search_titles("topics", "red wigdet")
    return found.select(F.col("unit_id").alias("key"), F.col("topic_title").alias("title"), "shared", "combined")


@query(
    f"""
    WITH {_COURSE}
    SELECT branch_name, count(*) AS n_experiments FROM orders JOIN course ON course = o_custkey
    WHERE sem <= 3 AND category IN ('PCC', 'PEC') GROUP BY branch_name
    """
)
def catalog_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Readers see the first semesters and two categories of courses; answers hold nothing else."""
    policies = {"semesters": [F.col("semester_number") <= 3], "courses": [F.col("category") == "PCC", F.col("category") == "PEC"]}
    seen = derive(spark, folder).seen_through(policies)
    return seen.lab_curriculum().groupBy("branch_name").agg(F.count(F.lit(1)).alias("n_experiments"))


@query(
    f"""
    WITH {_COURSE}
    SELECT branch_code AS branch, CAST(count(*) AS BIGINT) AS n_courses,
           CAST((SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN course k ON k.course = o_custkey
                 WHERE k.branch_code = course.branch_code) AS BIGINT) AS n_topics
    FROM course GROUP BY branch_code
    """
)
def catalog_views(spark: SparkSession, folder: str) -> DataFrame:
    """The standing questions under their names, asked in SQL."""
    names = derive(spark, folder).register(spark, prefix="catalog_")
    return spark.sql(
        "SELECT branch, count(*) AS n_courses, sum(total_topics) AS n_topics FROM {view} GROUP BY branch",
        view=spark.table(names["subject_summary"]),
    )
