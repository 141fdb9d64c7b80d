"""Declared constraints as distributed checks.

A database stops at the first bad row; here every rule reports how many rows
break it, and `offending_rows` returns them. All reports have the columns
`table, constraint, kind, n_violations`.

Row rules of one table are counted together in one scan. Key rules count per
key value before anything else moves, so a value that holds a large share of
the rows travels as one small record per map task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.functions.types import fits_numeric, fits_type, fits_varchar
from espalier.spec import Domain, ForeignKey, TableSpec, names

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("constraint", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("n_violations", T.LongType()),
    ]
)

_ROWS = "__rows"


@dataclass(frozen=True)
class RowRule:
    """A rule that one row breaks on its own. `broken` is TRUE only for those."""

    name: str
    kind: str
    broken: Column


@dataclass(frozen=True)
class UniqueRule:
    """No two rows share a key. With `required`, a NULL in the key breaks it
    too (a primary key); without, keys that hold a NULL never collide."""

    columns: tuple[str, ...]
    required: bool = False

    @property
    def name(self) -> str:
        return ",".join(self.columns)

    @property
    def kind(self) -> str:
        return "primary_key" if self.required else "unique"


# --- rules ---------------------------------------------------------------


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def not_null(column: str) -> RowRule:
    return RowRule(column, "not_null", _c(column).isNull())


def satisfies(condition: Column, name: str) -> RowRule:
    """An unknown condition passes: only a FALSE one breaks the rule."""
    return RowRule(name, "check", F.coalesce(~condition, F.lit(False)))


def in_domain(column: str, domain: Domain) -> RowRule:
    broken = F.coalesce(~domain.contains(_c(column)), F.lit(False))
    return RowRule(column, "domain", broken)


def within_length(column: str, n: int) -> RowRule:
    return RowRule(column, "length", F.coalesce(~fits_varchar(_c(column), n), F.lit(False)))


def within_numeric(column: str, precision: int, scale: int) -> RowRule:
    return RowRule(column, "numeric", ~fits_numeric(_c(column), precision, scale))


def castable(column: str, target: T.DataType) -> RowRule:
    return RowRule(column, "type", ~fits_type(_c(column), target))


# --- reports -------------------------------------------------------------


def report_rows(df: DataFrame, rules: Sequence[RowRule], table: str) -> DataFrame:
    """One scan for all row rules, then one output row per rule."""
    counted = df.agg(*[F.count_if(rule.broken).alias(f"n{i}") for i, rule in enumerate(rules)])
    lines = [
        F.struct(
            F.lit(table).alias("table"),
            F.lit(rule.name).alias("constraint"),
            F.lit(rule.kind).alias("kind"),
            F.col(f"n{i}").alias("n_violations"),
        )
        for i, rule in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*lines)))


def _line(bad: DataFrame, table: str, name: str, kind: str) -> DataFrame:
    """The report line for key values that break a rule, by their rows."""
    return bad.agg(
        F.lit(table).alias("table"),
        F.lit(name).alias("constraint"),
        F.lit(kind).alias("kind"),
        F.coalesce(F.sum(_ROWS), F.lit(0)).cast("long").alias("n_violations"),
    )


def _any_null(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [_c(c).isNull() for c in columns])


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(_ROWS))


def _breaks_unique(rule: UniqueRule) -> Column:
    repeated = F.col(_ROWS) > 1
    incomplete = _any_null(rule.columns)
    return repeated | incomplete if rule.required else repeated & ~incomplete


def report_unique(df: DataFrame, rule: UniqueRule, table: str) -> DataFrame:
    """Counts every row of a repeated key, not only the surplus ones."""
    bad = key_counts(df, rule.columns).filter(_breaks_unique(rule))
    return _line(bad, table, rule.name, rule.kind)


def duplicate_keys(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    """Each repeated key once, with its number of rows."""
    rule = UniqueRule(names(columns))
    return key_counts(df, rule.columns).filter(_breaks_unique(rule)).withColumnRenamed(_ROWS, "n_rows")


def _orphan_counts(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Key values without a parent. Both sides are reduced to one row per value
    first, so the join sees each once, however often child or parent repeat it."""
    used = key_counts(child.filter(~_any_null(columns)), columns)
    known = parent.select(*[_c(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)]).distinct()
    match = [_c(c) == F.col(f"__p{i}") for i, c in enumerate(columns)]
    return used.join(known, match, "left_anti")


def report_key(
    parent: DataFrame,
    columns: Sequence[str],
    table: str,
    uniques: Sequence[UniqueRule],
    children: Sequence[tuple[str, DataFrame, ForeignKey]],
) -> DataFrame:
    """All rules on one key of `parent`, its own and those of its children
    `(table, rows, key)`, from one grouping of parent and child keys."""
    slots = [f"__k{i}" for i in range(len(columns))]
    sides = [parent.select(*[_c(c).alias(k) for c, k in zip(columns, slots)], F.lit(0).alias("__side"))]
    for i, (_, rows, key) in enumerate(children):
        held = rows.filter(~_any_null(key.columns))
        sides.append(held.select(*[_c(c).alias(k) for c, k in zip(key.columns, slots)], F.lit(i + 1).alias("__side")))
    counts = [F.count_if(F.col("__side") == i).alias(f"__n{i}") for i in range(len(sides))]
    grouped = reduce(DataFrame.union, sides).groupBy(*slots).agg(*counts)
    own = F.col("__n0")
    lines, sums = [], []
    for rule in uniques:
        incomplete = _any_null(slots)
        broken = (own > 1) | incomplete if rule.required else (own > 1) & ~incomplete
        sums.append(F.sum(F.when(broken, own)))
        lines.append((table, rule.name, rule.kind))
    for i, (child, _, key) in enumerate(children):
        sums.append(F.sum(F.when(own == 0, F.col(f"__n{i + 1}"))))
        lines.append((child, f"{','.join(key.columns)}->{key.parent}", "foreign_key"))
    total = grouped.agg(*[F.coalesce(s, F.lit(0)).cast("long").alias(f"__s{i}") for i, s in enumerate(sums)])
    structs = [
        F.struct(
            F.lit(t).alias("table"), F.lit(n).alias("constraint"), F.lit(k).alias("kind"), F.col(f"__s{i}").alias("n_violations")
        )
        for i, (t, n, k) in enumerate(lines)
    ]
    return total.select(F.inline(F.array(*structs)))


def report_foreign_key(child: DataFrame, key: ForeignKey, parent: DataFrame, table: str) -> DataFrame:
    orphans = _orphan_counts(child, key.columns, parent, key.parent_columns)
    return _line(orphans, table, f"{','.join(key.columns)}->{key.parent}", "foreign_key")


# --- offending rows ------------------------------------------------------


def offending_rows(df: DataFrame, rule: RowRule | UniqueRule | ForeignKey, parent: DataFrame | None = None) -> DataFrame:
    """The rows of `df` that break `rule`; a foreign key needs its `parent`."""
    if isinstance(rule, RowRule):
        return df.filter(rule.broken)
    if isinstance(rule, UniqueRule):
        bad = key_counts(df, rule.columns).filter(_breaks_unique(rule))
        columns = rule.columns
    else:
        if parent is None:
            raise ValueError("a foreign key needs its parent table")
        bad = _orphan_counts(df, rule.columns, parent, rule.parent_columns)
        columns = rule.columns
    marked = bad.select(*[_c(c).alias(f"__k{i}") for i, c in enumerate(columns)])
    match = [_c(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(columns)]
    return df.join(marked, match, "left_semi")


# --- single checks -------------------------------------------------------


def check_not_null(df: DataFrame, columns: str | Iterable[str], table: str = "") -> DataFrame:
    return report_rows(df, [not_null(c) for c in names(columns)], table)


def check_primary_key(df: DataFrame, columns: str | Iterable[str], table: str = "") -> DataFrame:
    return report_unique(df, UniqueRule(names(columns), required=True), table)


def check_unique(df: DataFrame, columns: str | Iterable[str], table: str = "") -> DataFrame:
    return report_unique(df, UniqueRule(names(columns)), table)


def check(df: DataFrame, condition: Column, name: str, table: str = "") -> DataFrame:
    return report_rows(df, [satisfies(condition, name)], table)


def check_domain(df: DataFrame, column: str, domain: Domain, table: str = "") -> DataFrame:
    return report_rows(df, [in_domain(column, domain)], table)


def check_length(df: DataFrame, column: str, n: int, table: str = "") -> DataFrame:
    return report_rows(df, [within_length(column, n)], table)


def check_numeric(df: DataFrame, column: str, precision: int, scale: int, table: str = "") -> DataFrame:
    return report_rows(df, [within_numeric(column, precision, scale)], table)


def check_foreign_key(
    child: DataFrame,
    columns: str | Iterable[str],
    parent: DataFrame,
    parent_columns: str | Iterable[str],
    table: str = "",
    parent_table: str = "",
) -> DataFrame:
    key = ForeignKey(names(columns), parent_table, names(parent_columns))
    return report_foreign_key(child, key, parent, table)


# --- whole tables --------------------------------------------------------


def row_rules(spec: TableSpec) -> list[RowRule]:
    """Every rule of `spec` that one row can break on its own."""
    rules = []
    for column in spec.columns:
        if column.required:
            rules.append(not_null(column.name))
        if column.max_length is not None:
            rules.append(within_length(column.name, column.max_length))
        if column.domain is not None:
            rules.append(in_domain(column.name, column.domain))
    rules += [satisfies(c.condition(), c.name) for c in spec.checks]
    return rules


def validate(tables: dict[str, DataFrame], specs: Sequence[TableSpec]) -> DataFrame:
    """One line per declared constraint of every table, as one query.

    A column whose type isn't the declared one gets a line for the values that
    don't fit. Without any constraint the report is empty. `tables` has to hold
    the parents of all foreign keys. A key and all references to it are judged
    from one grouping.
    """
    reports = []
    for spec in specs:
        df = tables[spec.name]
        rules = [*type_rules(df, spec), *row_rules(spec)]
        if rules:
            reports.append(report_rows(df, rules, spec.name))
    reports += key_reports(tables, specs)
    if not reports:
        return next(iter(tables.values())).sparkSession.createDataFrame([], REPORT_SCHEMA)
    return reduce(DataFrame.union, reports)


def type_rules(df: DataFrame, spec: TableSpec) -> list[RowRule]:
    """Rules for the columns of `df` whose type isn't the declared one."""
    declared = {c.name: c.type for c in spec.columns}
    return [castable(f.name, declared[f.name]) for f in df.schema if declared.get(f.name, f.dataType) != f.dataType]


def key_reports(tables: Mapping[str, DataFrame], specs: Sequence[TableSpec]) -> list[DataFrame]:
    """The report lines of all keys, one report for each key and the references to it."""
    reports = []
    uniques: dict[tuple[str, tuple[str, ...]], list[UniqueRule]] = {}
    children: dict[tuple[str, tuple[str, ...]], list[tuple[str, DataFrame, ForeignKey]]] = {}
    for spec in specs:
        df = tables[spec.name]
        own = [UniqueRule(spec.primary_key, required=True)] if spec.primary_key else []
        for rule in (*own, *[UniqueRule(columns) for columns in spec.unique]):
            uniques.setdefault((spec.name, rule.columns), []).append(rule)
        for key in spec.foreign_keys:
            children.setdefault((key.parent, key.parent_columns), []).append((spec.name, df, key))
    for table, columns in dict.fromkeys((*uniques, *children)):
        at = (table, columns)
        reports.append(report_key(tables[table], columns, table, uniques.get(at, ()), children.get(at, ())))
    return reports


def validate_raw(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Which values of a loosely typed batch (text, say) wouldn't load into `spec`."""
    rules = [castable(c.name, c.type) for c in spec.columns if c.name in df.columns]
    return report_rows(df, rules, spec.name)
