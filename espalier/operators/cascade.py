"""Deleting rows together with everything that depends on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.spec import ForeignKey

_DOOMED = "__doomed"


@dataclass(frozen=True)
class Cascade:
    """The rows that go, per table that the delete reaches, and the rows that stay, per table.

    `counted` says how many go, where the delete has counted them on its way."""

    deleted: dict[str, DataFrame]
    surviving: dict[str, DataFrame]
    counted: dict[str, int] | None = None

    def counts(self) -> DataFrame:
        """`table, n_deleted` for every table the delete reaches."""
        if self.counted is not None:
            spark = next(iter(self.deleted.values())).sparkSession
            return spark.createDataFrame(list(self.counted.items()), "table string, n_deleted long")
        lines = [
            df.agg(F.count(F.lit(1)).alias("n_deleted")).select(F.lit(name).alias("table"), "n_deleted")
            for name, df in self.deleted.items()
        ]
        return reduce(DataFrame.unionByName, lines)


def cascade_delete(
    tables: dict[str, DataFrame],
    foreign_keys: dict[str, Sequence[ForeignKey]],
    root: str,
    predicate: Column,
    durable: bool = False,
) -> Cascade:
    """Delete the rows of `root` that satisfy `predicate`, and their dependants.

    `foreign_keys` lists each child table's keys. Tables are visited parents
    first; a row is marked once, by whichever of its parents goes, so paths
    that meet again (a diamond) neither miss nor repeat it and no key of the
    child itself is needed. A NULL foreign key depends on nothing.

    Only distinct parent keys are joined in. With `durable`, one job per table
    stores its doomed keys in the shared folder and counts its doomed rows, so
    every table is read once however deep the graph, and nothing above a table
    is done again for what lies below it.
    """
    deleted: dict[str, DataFrame] = {}
    surviving: dict[str, DataFrame] = {}
    doomed: dict[tuple[str, tuple[str, ...]], DataFrame] = {}
    graph = {child: {k.parent for k in keys} for child, keys in foreign_keys.items()}
    counted: dict[str, int] = {}
    wanted = {(k.parent, k.parent_columns) for keys in foreign_keys.values() for k in keys}
    graph.setdefault(root, set())  # a root without keys or children is deleted from all the same
    for name in TopologicalSorter(graph).static_order():
        if name == root:
            # An unknown predicate deletes nothing.
            marked = tables[name].withColumn(_DOOMED, F.coalesce(predicate, F.lit(False)))
        else:
            live = [k for k in foreign_keys.get(name, ()) if k.parent in deleted]
            if not live:
                continue
            for key in live:
                target = (key.parent, key.parent_columns)
                if target not in doomed:
                    doomed[target] = deleted[key.parent].select(*[f"`{c}`" for c in key.parent_columns]).distinct()
            marked = _mark(tables[name], [(k, doomed[k.parent, k.parent_columns]) for k in live])
        deleted[name] = marked.filter(_DOOMED).drop(_DOOMED)
        surviving[name] = marked.filter(~F.col(_DOOMED)).drop(_DOOMED)
        if durable:
            keys = [columns for table, columns in wanted if table == name]
            stored, counted[name] = _stored(deleted[name], keys, name)
            doomed.update({(name, c): stored.select(*[f"`{x}`" for x in c]).distinct() for c in keys})
    untouched = {name: df for name, df in tables.items() if name not in surviving}
    return Cascade(deleted, {**surviving, **untouched}, counted if durable else None)


def _stored(gone: DataFrame, keys: Sequence[tuple[str, ...]], name: str) -> tuple[DataFrame, int]:
    """The columns of all `keys`, stored, and the number of rows, both by one job."""
    seen = Observation()
    columns = dict.fromkeys(c for key in keys for c in key)
    slim = gone.select(*[f"`{c}`" for c in columns]).observe(seen, F.count(F.lit(1)).alias("n"))
    if columns:
        slim = materialize(slim, f"cascade-{name}")
    else:  # nothing refers to this table: its rows are only counted
        slim.write.format("noop").mode("overwrite").save()
    return slim, seen.get["n"]


def _mark(df: DataFrame, doomed: Sequence[tuple[ForeignKey, DataFrame]]) -> DataFrame:
    flags = []
    for i, (key, keys) in enumerate(doomed):
        flag = f"__gone{i}"
        gone_keys = keys.select(
            *[F.col(f"`{p}`").alias(f"__d{i}_{j}") for j, p in enumerate(key.parent_columns)],
            F.lit(True).alias(flag),
        )
        match = [F.col(f"`{c}`") == F.col(f"__d{i}_{j}") for j, c in enumerate(key.columns)]
        df = df.join(gone_keys, match, "left").drop(
            *[f"__d{i}_{j}" for j in range(len(key.columns))]
        )
        flags.append(F.coalesce(F.col(flag), F.lit(False)))
    gone = reduce(lambda a, b: a | b, flags)
    return df.withColumn(_DOOMED, gone).drop(*[f"__gone{i}" for i in range(len(doomed))])
