"""An audit that follows a stream of changes without reading the tables again.

For every key of the declared tables a tally is kept: how many rows of its table
hold the key, and how many rows of each table that refers to it do. A batch of
inserted and deleted rows becomes signed tallies of the keys it touches. Only
these keys' stored tallies are looked up, and only the difference that they make
is added to the totals of each rule. Tallies are additive, so a batch adds a run
of its own, and runs are summed up on reading and merged now and then.

A batch counts when its line is in the log, one file, which names the runs and
holds the totals; a batch that is in the log already changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.operators.constraints import REPORT_SCHEMA, UniqueRule, row_rules
from espalier.operators.pruning import key_ranges
from espalier.spec import ForeignKey, TableSpec

# So many runs are read side by side before they are merged.
MOST_RUNS = 16
_SIGN = "__sign"
_LOG = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("batch", T.StringType()),
        T.StructField("runs", T.ArrayType(T.StringType())),
        T.StructField("totals", T.ArrayType(REPORT_SCHEMA)),
    ]
)


@dataclass(frozen=True)
class _Key:
    """A key of a table, the rules on it, and the references to it."""

    table: str
    columns: tuple[str, ...]
    uniques: list[UniqueRule] = field(default_factory=list)
    children: list[tuple[str, ForeignKey]] = field(default_factory=list)

    @property
    def slots(self) -> list[str]:
        return [f"__k{i}" for i in range(len(self.columns))]

    @property
    def counts(self) -> list[str]:
        return [f"__n{i}" for i in range(len(self.children) + 1)]

    def lines(self) -> list[tuple[str, str, str]]:
        own = [(self.table, rule.name, rule.kind) for rule in self.uniques]
        return own + [(t, f"{','.join(k.columns)}->{k.parent}", "foreign_key") for t, k in self.children]

    def broken(self, counts: Sequence[Column]) -> list[Column]:
        """Rows that break each rule, from the tallies of one key."""
        own, incomplete = counts[0], reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.slots])
        found = []
        for rule in self.uniques:
            bad = (own > 1) | incomplete if rule.required else (own > 1) & ~incomplete
            found.append(F.when(bad, own).otherwise(F.lit(0)))
        return found + [F.when(own == 0, n).otherwise(F.lit(0)) for n in counts[1:]]


class Audit:
    """The running audit of the tables of `specs`, kept under `path`. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, specs: Sequence[TableSpec]):
        self.spark, self.path, self.specs = spark, path, {s.name: s for s in specs}
        keys: dict[tuple[str, tuple[str, ...]], _Key] = {}
        for spec in specs:
            rules = [UniqueRule(spec.primary_key, required=True)] if spec.primary_key else []
            for rule in (*rules, *map(UniqueRule, spec.unique)):
                keys.setdefault((spec.name, rule.columns), _Key(spec.name, rule.columns)).uniques.append(rule)
            for key in spec.foreign_keys:
                at = (key.parent, key.parent_columns)
                if key.parent not in self.specs:
                    raise ValueError(f"{spec.name} refers to {key.parent}, which isn't among the tables")
                keys.setdefault(at, _Key(*at)).children.append((spec.name, key))
        self.keys = list(keys.values())

    # --- reading -----------------------------------------------------------------

    def report(self) -> DataFrame:
        """`table, constraint, kind, n_violations`, one line per declared constraint, as `validate` gives it."""
        _, _, totals = self._state()
        return self.spark.createDataFrame([(*line, n) for line, n in totals.items()], REPORT_SCHEMA)

    def _lines(self) -> list[tuple[str, str, str]]:
        rows = [(s.name, r.name, r.kind) for s in self.specs.values() for r in row_rules(s)]
        return rows + [line for key in self.keys for line in key.lines()]

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).json(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)

    def _state(self) -> tuple[int, list[str], dict[tuple[str, str, str], int]]:
        """The last number, the runs that count, and the totals."""
        last = self._log().agg(F.max_by(F.struct("*"), "number").alias("last")).first()["last"]
        if last is None:
            return 0, [], dict.fromkeys(self._lines(), 0)
        return last["number"], last["runs"], {tuple(t)[:3]: t["n_violations"] for t in last["totals"]}

    # --- changes -----------------------------------------------------------------

    def apply(
        self,
        batch: str,
        inserted: Mapping[str, DataFrame] | None = None,
        deleted: Mapping[str, DataFrame] | None = None,
    ) -> DataFrame:
        """Take the rows of a batch in, and give the report after it.

        The first batch is a load of whole tables. A deleted row has to be given
        with all its columns, as it was; a change is both. Nothing checks that
        a deleted row was there: a key may then have a negative tally, which
        breaks no rule. The rows have the declared types.
        """
        if self._log().filter(F.col("batch") == batch).limit(1).count():
            return self.report()
        number, runs, totals = self._state()
        run = f"{self.path}/runs/{number + 1}-{uuid.uuid4().hex}"
        changed = self._signed(inserted or {}, deleted or {})
        reports, touched = [self._row_changes(name, rows) for name, rows in changed.items() if row_rules(self.specs[name])], False
        for i, key in enumerate(self.keys):
            sides = [(key.table, key.columns), *[(t, k.columns) for t, k in key.children]]
            if any(t in changed for t, _ in sides):
                delta, touched = self._delta(key, changed, sides, f"{run}/key{i}"), True
                reports.append(self._key_changes(key, delta, self._kept(i, key, runs)))
        if reports:
            # A line per rule of the tables that the batch touches.
            for row in reduce(DataFrame.union, reports).collect():
                totals[tuple(row)[:3]] += row["n_violations"]
        runs = [*runs, run] if touched else runs
        self._commit(number + 1, batch, self._merged(number + 1, runs) if len(runs) > MOST_RUNS else runs, totals)
        return self.report()

    def _commit(self, number: int, batch: str, runs: list[str], totals: Mapping[tuple[str, str, str], int]) -> None:
        line = [(number, batch, runs, [(*at, n) for at, n in totals.items()])]
        self.spark.createDataFrame(line, _LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def _signed(self, inserted: Mapping[str, DataFrame], deleted: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        changed: dict[str, DataFrame] = {}
        for tables, sign in ((inserted, 1), (deleted, -1)):
            for name, df in tables.items():
                columns = [F.col(f"`{c.name}`").cast(c.type).alias(c.name) for c in self.specs[name].columns]
                rows = df.select(*columns, F.lit(sign).alias(_SIGN))
                changed[name] = changed[name].unionByName(rows) if name in changed else rows
        return changed

    def _row_changes(self, name: str, rows: DataFrame) -> DataFrame:
        rules = row_rules(self.specs[name])
        sums = rows.agg(*[F.sum(F.when(r.broken, F.col(_SIGN))).alias(f"n{i}") for i, r in enumerate(rules)])
        return _spelled(sums, [(name, r.name, r.kind) for r in rules], [F.col(f"n{i}") for i in range(len(rules))])

    def _delta(
        self, key: _Key, changed: Mapping[str, DataFrame], sides: Sequence[tuple[str, tuple[str, ...]]], path: str
    ) -> DataFrame:
        """The signed tallies of the keys that the batch touches, stored in the order of the key."""
        kinds = [self.specs[key.table].column(c).type for c in key.columns]
        parts = []
        for side, (table, columns) in enumerate(sides):
            if table in changed:
                held = [F.col(f"`{c}`").cast(kind).alias(slot) for c, kind, slot in zip(columns, kinds, key.slots)]
                rows = changed[table].select(*held, _SIGN, F.lit(side).alias("__side"))
                if side:  # a reference with a NULL refers to nothing
                    rows = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key.slots]))
                parts.append(rows)
        sums = [F.sum(F.when(F.col("__side") == i, F.col(_SIGN)).otherwise(F.lit(0))).alias(n) for i, n in enumerate(key.counts)]
        grouped = reduce(DataFrame.unionByName, parts).groupBy(*key.slots).agg(*sums)
        moved = grouped.filter(reduce(lambda a, b: a | b, [F.col(n) != 0 for n in key.counts]))
        moved.repartitionByRange(*key.slots).sortWithinPartitions(*key.slots).write.parquet(path)
        return self.spark.read.schema(moved.schema).parquet(path)

    def _kept(self, i: int, key: _Key, runs: Sequence[str]) -> DataFrame | None:
        """All stored rows of a key's tallies; a run without it has no folder for it."""
        kinds = [T.StructField(s, self.specs[key.table].column(c).type) for s, c in zip(key.slots, key.columns)]
        schema = T.StructType([*kinds, *[T.StructField(n, T.LongType()) for n in key.counts]])
        found = []
        for run in runs:
            try:
                found.append(self.spark.read.schema(schema).parquet(f"{run}/key{i}"))
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        return reduce(DataFrame.unionByName, found) if found else None

    def _key_changes(self, key: _Key, delta: DataFrame, kept: DataFrame | None) -> DataFrame:
        """What the batch adds to the violations of each rule on a key.

        Of the stored tallies only those of touched keys are read, by ranges of
        the key, and only those travel. A key with a NULL isn't looked up: the
        violations that it makes are its rows, however many there are."""
        before = [f"__b{i}" for i in range(len(key.counts))]
        rows = delta
        if kept is not None:
            near = key_ranges(delta, key.slots).prune(kept, key.slots)
            slots = [F.col(s).alias(f"__o{i}") for i, s in enumerate(key.slots)]
            same = [F.col(s) == F.col(f"__o{i}") for i, s in enumerate(key.slots)]
            met = near.join(delta.select(*slots), same, "left_semi")
            sums = met.groupBy(*key.slots).agg(*[F.sum(n).alias(b) for n, b in zip(key.counts, before)])
            rows = delta.join(sums, key.slots, "left")
        old = [F.coalesce(F.col(b), F.lit(0)) if kept is not None else F.lit(0) for b in before]
        new = [o + F.col(n) for o, n in zip(old, key.counts)]
        change = [F.sum(after - was).alias(f"s{i}") for i, (after, was) in enumerate(zip(key.broken(new), key.broken(old)))]
        if not change:
            return self.spark.createDataFrame([], REPORT_SCHEMA)
        return _spelled(rows.agg(*change), key.lines(), [F.col(f"s{i}") for i in range(len(change))])

    # --- upkeep ------------------------------------------------------------------

    def _merged(self, number: int, runs: Sequence[str]) -> list[str]:
        """One run in place of several; keys whose tallies are all zero go."""
        merged = f"{self.path}/runs/{number}-merged-{uuid.uuid4().hex}"
        for i, key in enumerate(self.keys):
            kept = self._kept(i, key, runs)
            if kept is not None:
                whole = kept.groupBy(*key.slots).agg(*[F.sum(n).alias(n) for n in key.counts])
                live = whole.filter(reduce(lambda a, b: a | b, [F.col(n) != 0 for n in key.counts]))
                live.repartitionByRange(*key.slots).sortWithinPartitions(*key.slots).write.parquet(f"{merged}/key{i}")
        return [merged]

    def compact(self) -> None:
        """Merge all runs; the report stays as it is."""
        number, runs, totals = self._state()
        if len(runs) > 1:
            self._commit(number + 1, f"compacted-{uuid.uuid4().hex}", self._merged(number + 1, runs), totals)


def _spelled(sums: DataFrame, lines: Sequence[tuple[str, str, str]], values: Sequence[Column]) -> DataFrame:
    """One row per line of a report from one row of sums."""
    structs = [
        F.struct(
            F.lit(t).alias("table"),
            F.lit(c).alias("constraint"),
            F.lit(k).alias("kind"),
            F.coalesce(n, F.lit(0)).cast("long").alias("n_violations"),
        )
        for (t, c, k), n in zip(lines, values, strict=True)
    ]
    return sums.select(F.inline(F.array(*structs)))
