"""A course catalogue: eight declared tables and four standing questions.

    branches > semesters > courses > course_units > topics
                                   > lab_experiments
                                   > recommended_books
    open_electives (on its own)

A course names its branch twice, through its semester and directly; only the
semester decides where it appears, and deleting a branch reaches it by both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.functions.trigram import Threshold
from espalier.operators.cascade import Cascade, cascade_delete
from espalier.operators.constraints import validate
from espalier.operators.hierarchy import Hierarchy, Level
from espalier.operators.policy import apply_policy
from espalier.operators.search import fuzzy_search
from espalier.sources.ingest import register
from espalier.spec import Check, Column, Domain, ForeignKey, TableSpec

# The closed vocabularies, in rank order.
CATEGORY = Domain("course_category_type", ("BSC", "ESC", "HSMC", "PCC", "PEC", "OE", "PSIT", "FEC"))
DELIVERY = Domain("course_delivery_type", ("THEORY", "PRACTICAL", "SESSIONAL", "PROJECT", "SEMINAR"))
IMPORTANCE = Domain("importance_level_type", ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
FREQUENCY = Domain("exam_frequency_type", ("VERY_FREQUENT", "FREQUENT", "OCCASIONAL"))
BOOK_TYPE = Domain("book_category_type", ("TEXT_BOOK", "REFERENCE_BOOK"))
# The columns that title search reads.
TITLES = {"courses": "course_title", "topics": "topic_title"}

_TEXT, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_TEXTS = T.ArrayType(_TEXT)


def _text(name: str, n: int | None = None, **rest: object) -> Column:
    return Column(name, _TEXT, max_length=n, **rest)


def _int(name: str, **rest: object) -> Column:
    return Column(name, _INT, **rest)


def _serial() -> Column:
    return Column("id", _LONG, required=True, generated=True)


def _created() -> Column:
    return Column("created_at", T.TimestampType(), required=True, default=lambda now: now)


def _parent(column: str, parent: str) -> ForeignKey:
    return ForeignKey((column,), parent, ("id",))


def catalog_specs(university: str, tips: str = "exam_tips") -> dict[str, TableSpec]:
    """The declared tables. `university` is the default of the column of that
    name, and `tips` names the topics' column of advice."""
    # Column names, lengths, defaults and ranges.
    specs = (
        TableSpec(
            "branches",
            (
                _text("id", 20, required=True),
                _text("code", 10, required=True),
                _text("name", 255, required=True),
                _text("university", 255, default=university),
                _text("degree", 50, default="B.Tech"),
                _text("effective_session", 50, required=True),
                _created(),
            ),
            primary_key=("id",),
            unique=(("code",),),
        ),
        TableSpec(
            "semesters",
            (
                _serial(),
                _text("branch_id", 20, required=True),
                _int("semester_number", required=True),
                _int("year_number", required=True),
                _text("academic_title", 100, required=True),
            ),
            primary_key=("id",),
            unique=(("branch_id", "semester_number"),),
            checks=(
                Check("semester_number 1..8", lambda: F.col("semester_number").between(1, 8)),
                Check("year_number 1..4", lambda: F.col("year_number").between(1, 4)),
            ),
            foreign_keys=(_parent("branch_id", "branches"),),
        ),
        TableSpec(
            "courses",
            (
                _serial(),
                Column("semester_id", _LONG, required=True),
                _text("branch_id", 20, required=True),
                _text("course_code", 30, required=True),
                _text("course_title", 255, required=True),
                _text("category", required=True, domain=CATEGORY),
                _text("delivery_type", required=True, domain=DELIVERY),
                Column("credits", T.DecimalType(3, 1), required=True),
                _int("lecture_hours", default=0),
                _int("tutorial_hours", default=0),
                _int("practical_hours", default=0),
                _int("exam_hours", default=3),
                _int("ia_marks", required=True, default=30),
                _int("ete_marks", required=True, default=70),
                _int("total_marks", required=True, default=100),
                Column("course_objectives", _TEXTS),
                Column("course_outcomes", _TEXTS),
                _created(),
            ),
            primary_key=("id",),
            unique=(("semester_id", "course_code"),),
            foreign_keys=(_parent("semester_id", "semesters"), _parent("branch_id", "branches")),
        ),
        TableSpec(
            "course_units",
            (
                _serial(),
                Column("course_id", _LONG, required=True),
                _int("unit_number", required=True),
                _text("unit_title", 255, required=True),
                _int("lecture_hours", required=True, default=0),
                _text("description"),
            ),
            primary_key=("id",),
            unique=(("course_id", "unit_number"),),
            foreign_keys=(_parent("course_id", "courses"),),
        ),
        TableSpec(
            "topics",
            (
                _serial(),
                Column("unit_id", _LONG, required=True),
                _text("topic_title", 255, required=True),
                _text("topic_description"),
                Column("is_high_yield", T.BooleanType(), default=False),
                _text("importance_level", domain=IMPORTANCE, default="MEDIUM"),
                _text("exam_frequency", domain=FREQUENCY, default="OCCASIONAL"),
                _text(tips),
                Column("key_concepts", _TEXTS),
                _created(),
            ),
            primary_key=("id",),
            foreign_keys=(_parent("unit_id", "course_units"),),
        ),
        TableSpec(
            "lab_experiments",
            (
                _serial(),
                Column("course_id", _LONG, required=True),
                _int("experiment_number", required=True),
                _text("title", 255, required=True),
                _text("description", required=True),
                _text("tools_used", 255),
            ),
            primary_key=("id",),
            unique=(("course_id", "experiment_number"),),
            foreign_keys=(_parent("course_id", "courses"),),
        ),
        TableSpec(
            "recommended_books",
            (
                _serial(),
                Column("course_id", _LONG, required=True),
                _text("book_type", required=True, domain=BOOK_TYPE),
                _text("title", 255, required=True),
                _text("authors", 255),
                _text("publisher", 255),
                _text("edition_year", 50),
            ),
            primary_key=("id",),
            foreign_keys=(_parent("course_id", "courses"),),
        ),
        TableSpec(
            "open_electives",
            (
                _serial(),
                _int("semester_number", required=True),
                _text("elective_group", 50, required=True),
                _text("subject_code", 30, required=True),
                _text("title", 255, required=True),
                _text("department", 100, required=True),
            ),
            primary_key=("id",),
            checks=(Check("semester_number 7 or 8", lambda: F.col("semester_number").isin(7, 8)),),
        ),
    )
    return {spec.name: spec for spec in specs}


def _columns(**levels: str) -> dict[str, str]:
    """`output="level.column"` pairs; a bare level keeps the output's own name."""
    return {out: ref if "." in ref else f"{ref}.{out}" for out, ref in levels.items()}


@dataclass(frozen=True)
class Catalog:
    """The tables, and what readers ask of them. Answers come unsorted unless
    `ordered`; sorting a large answer costs a range exchange."""

    tables: Mapping[str, DataFrame]
    specs: Mapping[str, TableSpec]
    tips: str = "exam_tips"

    def _tree(self, *below: tuple[str, str]) -> Hierarchy:
        chain = [("branches", None), ("semesters", "branch_id"), ("courses", "semester_id"), *below]
        return Hierarchy([Level(name, self.tables[name], "id", up) for name, up in chain])

    def _topic_tree(self) -> Hierarchy:
        return self._tree(("course_units", "course_id"), ("topics", "unit_id"))

    def outline(self, ordered: bool = False) -> DataFrame:
        """Every topic in its place; a unit without topics gives one row, a
        course without units none."""
        order = ["branches.id", "semesters.semester_number", "courses.course_code"]
        order += ["course_units.unit_number", "topics.id"]
        columns = _columns(
            branch_name="branches.name",
            branch_code="branches.code",
            semester_number="semesters",
            year_number="semesters",
            course_code="courses",
            course_title="courses",
            course_category="courses.category",
            delivery_type="courses",
            credits="courses",
            unit_number="course_units",
            unit_title="course_units",
            unit_hours="course_units.lecture_hours",
            topic_title="topics",
            topic_description="topics",
            is_high_yield="topics",
            importance_level="topics",
            exam_frequency="topics",
        )
        columns[self.tips] = f"topics.{self.tips}"
        return self._topic_tree().full(columns, order if ordered else ())

    def high_yield_topics(self, ordered: bool = False) -> DataFrame:
        """Topics flagged as high-yield, with their key concepts."""
        order = ["semesters.semester_number", "courses.course_code", "course_units.unit_number"]
        columns = _columns(
            branch="branches.code",
            sem="semesters.semester_number",
            course_code="courses",
            course_title="courses",
            unit="course_units.unit_number",
            unit_title="course_units",
            topic_title="topics",
            importance_level="topics",
            exam_frequency="topics",
        )
        columns[self.tips] = f"topics.{self.tips}"
        columns["key_concepts"] = "topics.key_concepts"
        flagged: SparkColumn = F.col("is_high_yield")
        return self._topic_tree().flagged(flagged, columns, order if ordered else ())

    def lab_curriculum(self, ordered: bool = False) -> DataFrame:
        """Every experiment with its course and branch."""
        order = ["branches.id", "semesters.semester_number", "courses.course_code"]
        order.append("lab_experiments.experiment_number")
        columns = _columns(
            branch_name="branches.name",
            semester_number="semesters",
            course_code="courses",
            course_title="courses",
            credits="courses",
            experiment_number="lab_experiments",
            experiment_title="lab_experiments.title",
            experiment_description="lab_experiments.description",
            tools_used="lab_experiments",
        )
        return self._tree(("lab_experiments", "course_id")).children(None, columns, order if ordered else ())

    def subject_summary(self, ordered: bool = False) -> DataFrame:
        """Units, topics and high-yield topics per course, zeros included."""
        order = ["branches.code", "semesters.semester_number", "courses.course_code"]
        columns = _columns(
            branch="branches.code",
            sem="semesters.semester_number",
            course_code="courses",
            course_title="courses",
            category="courses",
            delivery_type="courses",
            credits="courses",
            ia_marks="courses",
            ete_marks="courses",
            total_marks="courses",
        )
        counts = {
            "course_units": "total_units",
            "topics": "total_topics",
            "flag": "high_yield_topics_count",
        }
        return self._topic_tree().summary(
            "courses", F.col("is_high_yield"), columns, counts, order if ordered else (), merge_equal=True
        )

    def search_titles(self, table: str, text: str, threshold: Threshold = Threshold()) -> DataFrame:
        """Courses or topics whose title is like `text`, with both trigram counts.

        One pass over the titles; for many searches store a `trigram_index` of
        them once and use `index_search`.
        """
        return fuzzy_search(self.tables[table], TITLES[table], text, threshold)

    def seen_through(self, policies: Mapping[str, Sequence[SparkColumn | bool]]) -> Catalog:
        """The catalogue as a reader sees it: of the tables named, only rows that
        one of their policies admits; other tables are open."""
        seen = {name: apply_policy(self.tables[name], *admitted) for name, admitted in policies.items()}
        return replace(self, tables={**self.tables, **seen})

    def register(self, spark: SparkSession, prefix: str = "") -> dict[str, str]:
        """Give the four questions names that SQL can use; the names by question."""
        asked = {
            "outline": self.outline(),
            "high_yield_topics": self.high_yield_topics(),
            "lab_curriculum": self.lab_curriculum(),
            "subject_summary": self.subject_summary(),
        }
        for question, rows in asked.items():
            register(spark, prefix + question, rows)
        return {question: prefix + question for question in asked}

    def audit(self) -> DataFrame:
        """One line per declared constraint of all tables."""
        return validate(dict(self.tables), list(self.specs.values()))

    def without_branches(self, doomed: SparkColumn, durable: bool = False) -> Cascade:
        """Drop branches and all that hangs below them."""
        keys = {name: spec.foreign_keys for name, spec in self.specs.items()}
        return cascade_delete(dict(self.tables), keys, "branches", doomed, durable)
