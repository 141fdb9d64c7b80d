"""Publishing a batch of tables all at once, or not at all.

Tables are written to a folder of their own run. The write itself counts the rows
that break a row rule or don't fit the declared shape, so a batch is read once;
only key columns are read back, for the rules on keys. Only if every check
passes is a manifest added, as one file, which is the single commit point: readers resolve each table through the newest manifest that names
it and never see a run without one. A reader who opens a run's folder directly has no such
guarantee.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.operators.constraints import (
    REPORT_SCHEMA,
    RowRule,
    key_reports,
    report_rows,
    row_rules,
    type_rules,
    within_length,
)
from espalier.sources.ingest import conform, scan
from espalier.sources.layout import write_declared
from espalier.spec import TableSpec

_WRITERS = 4
_MANIFEST = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("committed", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Publication:
    run: str
    committed: bool
    audit: DataFrame


def unknown_columns(df: DataFrame, spec: TableSpec) -> list[tuple]:
    """Findings for the columns that `spec` doesn't declare."""
    known = {c.name for c in spec.columns}
    return [(spec.name, c, "unknown_column", 1) for c in df.columns if c not in known]


def shape_rules(df: DataFrame, spec: TableSpec) -> list[RowRule]:
    """Which values don't fit the declared types and lengths."""
    bounded = [within_length(c.name, c.max_length) for c in spec.columns if c.max_length and c.name in df.columns]
    return [*type_rules(df, spec), *bounded]


def misshapen(tables: Mapping[str, DataFrame], specs: Sequence[TableSpec]) -> list[tuple]:
    """Findings that keep a batch from being written: columns that a table
    doesn't declare, and values that don't fit the declared types or lengths.
    One report over all tables."""
    found = [line for spec in specs for line in unknown_columns(tables[spec.name], spec)]
    rules = {spec.name: shape_rules(tables[spec.name], spec) for spec in specs}
    reports = [report_rows(tables[name], own, name) for name, own in rules.items() if own]
    if reports:
        found += [tuple(r) for r in reduce(DataFrame.union, reports).filter("n_violations > 0").collect()]
    return found


_UNFIT = "__unfit"


def _write(df: DataFrame, spec: TableSpec, path: str) -> tuple[list[tuple], list[tuple]]:
    """Write one table and say what its shape rules and its row rules have counted.

    The rules are counted where the rows are written: below a range exchange a
    sample would be counted as well. Whether a value fits is known before that,
    so it comes along. Values that don't fit are written as NULL: their run is
    never committed."""
    shape, rows = shape_rules(df, spec), row_rules(spec)
    flags = {f"{_UNFIT}{i}": rule.broken for i, rule in enumerate(shape)}
    marked = conform(df, spec, lenient=True, besides=flags)
    carried = [RowRule(rule.name, rule.kind, F.col(flag)) for rule, flag in zip(shape, flags)]
    seen = Observation()
    counts = [F.count_if(rule.broken).alias(f"n{i}") for i, rule in enumerate((*carried, *rows))]

    def watch(placed: DataFrame) -> DataFrame:
        return (placed.observe(seen, *counts) if counts else placed).drop(*flags)

    write_declared(marked, spec, path, mode="error", watch=watch)
    found = seen.get if counts else {}
    lines = [(spec.name, r.name, r.kind, found[f"n{i}"]) for i, r in enumerate((*carried, *rows))]
    return [line for line in lines[: len(carried)] if line[3]], lines[len(carried) :]


def publish(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    specs: Sequence[TableSpec],
    target: str,
    parents: Mapping[str, DataFrame] | None = None,
) -> Publication:
    """Write, audit, and commit only a clean batch, shaped to `specs`.

    `parents` are tables that the batch refers to but doesn't hold, such as
    those of an earlier publication. A batch with columns that a table
    doesn't declare isn't written, one with values that don't fit isn't looked at
    for other faults; the audit then says just that. Otherwise each table of the
    batch is read once, by its write, or twice if it declares a layout, which
    begins with a sample.
    """
    run = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    paths = {spec.name: f"{target}/runs/{run}/{spec.name}" for spec in specs}
    if any(unknown_columns(tables[spec.name], spec) for spec in specs):
        return Publication(run, False, spark.createDataFrame(misshapen(tables, specs), REPORT_SCHEMA))
    # The tables don't depend on each other, so small ones needn't wait for large ones.
    with ThreadPoolExecutor(_WRITERS) as pool:
        counted = list(pool.map(lambda spec: _write(tables[spec.name], spec, paths[spec.name]), specs))
    unfit = [line for shape, _ in counted for line in shape]
    if unfit:
        return Publication(run, False, spark.createDataFrame(unfit, REPORT_SCHEMA))
    staged = {spec.name: scan(spark, paths[spec.name], spec) for spec in specs}
    keys = key_reports({**(parents or {}), **staged}, specs)
    # One row per declared constraint, so the report is as small as the specs.
    findings = [line for _, rows in counted for line in rows]
    findings += [tuple(r) for r in reduce(DataFrame.union, keys).collect()] if keys else []
    audit = spark.createDataFrame(findings, REPORT_SCHEMA)
    clean = all(line[3] == 0 for line in findings)
    if clean:
        now = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}"
        manifest = [(run, name, path, now) for name, path in paths.items()]
        spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("append").json(
            f"{target}/manifests"
        )
    return Publication(run, clean, audit)


def _manifests(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).json(f"{target}/manifests")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_run(spark: SparkSession, target: str) -> str | None:
    """The run that committed last."""
    manifests = _manifests(spark, target)
    return None if manifests is None else manifests.agg(F.max_by("run", F.struct("committed", "run"))).first()[0]


def read_published(spark: SparkSession, target: str, spec: TableSpec) -> DataFrame:
    """`spec`'s table as of the last commit that names it."""
    manifests = _manifests(spark, target)
    newest = F.max_by("path", F.struct("committed", "run"))
    path = None if manifests is None else manifests.filter(F.col("table") == spec.name).agg(newest).first()[0]
    if path is None:
        raise LookupError(f"{spec.name} has not been published under {target}")
    return scan(spark, path, spec)
