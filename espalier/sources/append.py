"""Appending a batch that has been checked against what is already there."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.operators.constraints import REPORT_SCHEMA, UniqueRule, report_foreign_key, report_rows, row_rules
from espalier.operators.keys import assign_keys, last_key
from espalier.operators.pruning import key_ranges
from espalier.sources.ingest import conform, scan
from espalier.sources.layout import write_declared
from espalier.sources.publish import misshapen
from espalier.spec import TableSpec


@dataclass(frozen=True)
class Appended:
    committed: bool
    audit: DataFrame


def append_checked(
    df: DataFrame,
    spec: TableSpec,
    path: str,
    parents: Mapping[str, DataFrame] | None = None,
    order_by: str | Iterable[str] = (),
    as_of: dt.datetime | None = None,
) -> Appended:
    """Add `df` to the table at `path`, or nothing if a row breaks a constraint.

    A generated key that `df` lacks is numbered from the last one on, in
    `order_by` order. Every row rule is judged on the batch, every key on batch
    and table together, every foreign key against `parents`; a key of the table
    to itself also accepts the batch. Of the stored table, and of parents, only
    the ranges of keys that the batch holds are read, which skips files of a
    table that is clustered by the key, and of these only rows that share a key
    with the batch are counted. The batch is added in the declared layout, so a
    table stays clustered. One writer at a time: nothing locks `path`.
    """
    spark = df.sparkSession
    parents = parents or {}
    absent = [k.parent for k in spec.foreign_keys if k.parent not in parents and k.parent != spec.name]
    if absent:
        raise ValueError(f"{spec.name} refers to {', '.join(absent)}; pass them as `parents`")
    unfit = misshapen({spec.name: df}, [spec])
    if unfit:
        return Appended(False, spark.createDataFrame(unfit, REPORT_SCHEMA))
    stored = _stored(spark, spec, path)
    shaped = conform(df, spec, as_of)
    for key in (c.name for c in spec.columns if c.generated and c.name not in df.columns):
        shaped = assign_keys(shaped, order_by, last_key(stored, key), key)
    # Stored, so that the rows that are checked are the rows that are added.
    batch = materialize(shaped.select(*[F.col(f"`{c.name}`").cast(c.type) for c in spec.columns]), f"append-{spec.name}")
    reports = [report_rows(batch, rules, spec.name)] if (rules := row_rules(spec)) else []
    keys = [UniqueRule(spec.primary_key, required=True)] if spec.primary_key else []
    reports += [_report_new(batch, stored, rule, spec.name) for rule in (*keys, *map(UniqueRule, spec.unique))]
    for key in spec.foreign_keys:
        parent = parents[key.parent] if key.parent in parents else stored.unionByName(batch)
        near = key_ranges(batch, key.columns).prune(parent, key.parent_columns)
        reports.append(report_foreign_key(batch, key, near, spec.name))
    # One row per declared constraint.
    findings = reduce(DataFrame.union, reports).collect() if reports else []
    clean = all(row["n_violations"] == 0 for row in findings)
    if clean:
        write_declared(batch, spec, path, mode="append")
    return Appended(clean, spark.createDataFrame(findings, REPORT_SCHEMA))


def _stored(spark: SparkSession, spec: TableSpec, path: str) -> DataFrame:
    try:
        return scan(spark, path, spec)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], spec.schema)


def _report_new(batch: DataFrame, stored: DataFrame, rule: UniqueRule, table: str) -> DataFrame:
    """Rows of the batch whose key another row of the batch, or the table, holds."""
    slots = [f"__k{i}" for i in range(len(rule.columns))]
    columns = [F.col(f"`{c}`").alias(k) for c, k in zip(rule.columns, slots)]
    new = batch.select(*columns).groupBy(*slots).agg(F.count(F.lit(1)).alias("__rows"))
    near = key_ranges(batch, rule.columns).prune(stored, rule.columns)
    old = near.select(*columns, F.lit(True).alias("__old"))
    met = old.join(new.select(*slots), slots, "left_semi").distinct()
    incomplete = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in slots])
    again = (F.col("__rows") > 1) | F.coalesce(F.col("__old"), F.lit(False))
    broken = again | incomplete if rule.required else again & ~incomplete
    bad = new.join(met, slots, "left").filter(broken)
    return bad.agg(
        F.lit(table).alias("table"),
        F.lit(rule.name).alias("constraint"),
        F.lit(rule.kind).alias("kind"),
        F.coalesce(F.sum("__rows"), F.lit(0)).cast("long").alias("n_violations"),
    )
