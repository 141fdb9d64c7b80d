"""Questions over a chain of parent and child tables, root first.

Columns are named `level.column`, so that levels may use the same names.

The ancestors of a level are joined among themselves first, the small end before
the large, and meet the next, larger level once, so each join of leaf rows has
one exchange of them at most. Building a question starts no job. Which side is broadcast is
Spark's choice, by the sizes that adaptive execution measures, and skewed
partitions of the large side are split at run time.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from espalier.operators.bitmaps import counted, distinct_bitmaps
from espalier.spec import names


@dataclass(frozen=True)
class Level:
    """One table of the chain.

    `key` identifies its rows and `parent_key` holds the key of the level
    above. Set `unique=False` where rows may repeat a key below one parent;
    counts then take each key once. A key may hang below one parent only:
    `summary` counts it once below each, `summary_plain` and `summary_bitmap`
    once in all.
    """

    name: str
    df: DataFrame
    key: str | tuple[str, ...]
    parent_key: str | tuple[str, ...] | None = None
    unique: bool = True

    @property
    def keys(self) -> tuple[str, ...]:
        return names(self.key)

    @property
    def parents(self) -> tuple[str, ...]:
        return names(self.parent_key)


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


class Hierarchy:
    def __init__(self, levels: Sequence[Level]) -> None:
        self.levels = list(levels)
        self._chains: list[DataFrame] = []

    # --- rows ------------------------------------------------------------

    def full(
        self, columns: Mapping[str, str] | None = None, order_by: Iterable[str] = ()
    ) -> DataFrame:
        """The whole tree, one row per leaf, and one with NULL leaf columns for
        each lowest parent without leaves. Higher nodes without children don't
        appear.

        Equal to a left join of the leaves. Keys of parents without leaves are
        found by an anti join that sees each key once, and join the leaves as
        stubs; both then meet the ancestors in one inner join. A left join can't
        split a parent that holds a large share of the leaves, an inner one can.
        """
        leaf, parent = self.levels[-1], self.levels[-2]
        ups = [f"__up{i}" for i in range(len(leaf.parents))]
        whole = reduce(lambda a, b: a & b, [_ref(p).isNotNull() for p in leaf.parents])
        named = self._named(leaf)
        leaves = named.select("*", *[_ref(f"{leaf.name}.{p}").alias(up) for p, up in zip(leaf.parents, ups)])
        leaves = leaves.filter(reduce(lambda a, b: a & b, [F.col(up).isNotNull() for up in ups]))
        used = leaf.df.filter(whole).select(*[_ref(p).alias(f"__used{i}") for i, p in enumerate(leaf.parents)])
        keys = parent.df.select(*[_ref(k).alias(up) for k, up in zip(parent.keys, ups, strict=True)])
        absent = [F.col(up) == F.col(f"__used{i}") for i, up in enumerate(ups)]
        # A parent whose key is NULL has no leaves, and keeps its row.
        stubs = keys.join(used.distinct(), absent, "left_anti").distinct()
        stubs = stubs.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in named.schema], *ups)
        link = [F.col(up).eqNullSafe(_ref(k)) for up, k in zip(ups, self._keys(len(self.levels) - 2))]
        rows = leaves.unionByName(stubs).join(self._down_to(len(self.levels) - 2), link).drop(*ups)
        return self._show(rows, columns, order_by)

    def flagged(
        self, predicate: Column, columns: Mapping[str, str] | None = None, order_by: Iterable[str] = ()
    ) -> DataFrame:
        """Leaves for which `predicate` (over the leaf's own columns) is TRUE,
        each with all its ancestors."""
        last = len(self.levels) - 1
        leaf = self.levels[last]
        leaves = self._named(leaf, leaf.df.filter(predicate))
        return self._show(leaves.join(self._down_to(last - 1), self._link(last)), columns, order_by)

    def children(
        self,
        level: str | None = None,
        columns: Mapping[str, str] | None = None,
        order_by: Iterable[str] = (),
    ) -> DataFrame:
        """Every row of `level` (the last one by default) with its ancestors."""
        at = len(self.levels) - 1 if level is None else self._at(level)
        return self._show(self._down_to(at), columns, order_by)

    # --- counts ----------------------------------------------------------

    def summary(
        self,
        level: str,
        flag: Column | None = None,
        columns: Mapping[str, str] | None = None,
        counts: Mapping[str, str] | None = None,
        order_by: Iterable[str] = (),
        merge_equal: bool = False,
    ) -> DataFrame:
        """Per row of `level`: how many distinct rows of each lower level hang
        below it, and for how many leaves `flag` is TRUE. Nodes without
        descendants stay, with zeros.

        Counting happens below the joins: each level is reduced to one row per
        parent before it meets that parent, so no join multiplies rows.
        `counts` names the outputs by level, and by `flag`; the default is
        `n_<level>` and `n_flagged`. `merge_equal` adds up nodes that agree in
        all of `columns`, as grouping by these columns alone would; `order_by`
        may then only name shown columns.
        """
        at = self._at(level)
        titles = self._titles(at, flag, counts)
        below = self._counts_below(at, flag)
        nodes = self._down_to(at)
        match = [_ref(k) == F.col(f"__up{i}") for i, k in enumerate(self._keys(at))]
        rows = nodes.join(below, match, "left")
        totals = {out: F.coalesce(F.col(f"__n_{source}"), F.lit(0)) for source, out in titles.items()}
        picked = self._pick(columns, upto=at)
        if merge_equal:
            hidden = [c for c in order_by if c not in picked.values()]
            if hidden:
                raise ValueError(f"merged rows can't be sorted by {', '.join(hidden)}, which they don't show")
            groups = [_ref(source).alias(out) for out, source in picked.items()]
            merged = rows.groupBy(*groups).agg(*[F.sum(e).alias(out) for out, e in totals.items()])
            back = {source: out for out, source in picked.items()}
            order = [_ref(back[c]).asc_nulls_last() for c in order_by]
            if order:
                merged = merged.orderBy(*order)
            return merged.select(*[_ref(c) for c in (*picked, *totals)])
        if order_by:
            rows = rows.orderBy(*[_ref(c).asc_nulls_last() for c in order_by])
        return rows.select(
            *[_ref(source).alias(out) for out, source in picked.items()],
            *[e.alias(out) for out, e in totals.items()],
        )

    def summary_plain(
        self,
        level: str,
        flag: Column | None = None,
        columns: Mapping[str, str] | None = None,
        counts: Mapping[str, str] | None = None,
    ) -> DataFrame:
        """The same counts as one chain of left joins under distinct counts.

        Costs a copy of every joined row per count; kept to check `summary`
        against, and for chains whose lower keys repeat across parents.
        """
        at = self._at(level)
        titles = self._titles(at, flag, counts)
        leaf = self.levels[-1]
        rows = self._down_to(at)
        for i in range(at + 1, len(self.levels)):
            lower = self._named(self.levels[i])
            if i == len(self.levels) - 1 and flag is not None:
                flagged = leaf.df.withColumn("__flag", flag)
                lower = self._named(leaf, flagged)
            rows = rows.join(lower, self._link(i), "left")
        aggregates = [
            F.count_distinct(*[_ref(k) for k in self._keys(i)]).alias(titles[self.levels[i].name])
            for i in range(at + 1, len(self.levels))
        ]
        if flag is not None:
            first, *rest = [_ref(k) for k in self._keys(len(self.levels) - 1)]
            chosen = F.when(_ref(f"{leaf.name}.__flag"), first)
            aggregates.append(F.count_distinct(chosen, *rest).alias(titles["flag"]))
        picked = self._pick(columns, upto=at)
        own = dict.fromkeys([*self._keys(at), *picked.values()])
        grouped = rows.groupBy(*[_ref(c) for c in own]).agg(*aggregates)
        return grouped.select(
            *[_ref(source).alias(out) for out, source in picked.items()], *titles.values()
        )

    def summary_bitmap(
        self,
        level: str,
        ids: Mapping[str, Column],
        flag: Column | None = None,
        columns: Mapping[str, str] | None = None,
        counts: Mapping[str, str] | None = None,
    ) -> DataFrame:
        """The counts of `summary` for keys that may hang below several parents:
        each counts once per row of `level`, however many paths lead to it.

        `ids` gives, per lower level, a dense whole number that identifies its
        key, over its own columns. A level's numbers are gathered in bitmaps per
        row of `level`, and rows that repeat a number only set its bit again, so
        no row is copied per count and nothing is grouped by key. For upper levels
        that are few against what hangs below them.
        """
        at = self._at(level)
        titles = self._titles(at, flag, counts)
        ups = [f"__up{i}" for i in range(len(self.levels[at].keys))]
        rows = self._down_to(at)
        match = [_ref(k) == F.col(up) for k, up in zip(self._keys(at), ups)]
        paths: DataFrame | None = None
        for lv in self.levels[at + 1 :]:
            own = [_ref(k).alias(f"__key{i}") for i, k in enumerate(lv.keys)]
            is_leaf = lv is self.levels[-1]
            flagged = flag if is_leaf and flag is not None else F.lit(False)
            links = [_ref(p).alias(f"__to{i}") for i, p in enumerate(lv.parents)]
            here = lv.df.select(*links, *own, ids[lv.name].alias("__id"), flagged.alias("__flagged"))
            if paths is None:
                here = here.withColumnsRenamed({f"__to{i}": up for i, up in enumerate(ups)})
            else:
                above = paths.select(*ups, *[F.col(f"__key{i}").alias(f"__of{i}") for i in range(len(links))])
                here = here.join(above, [F.col(f"__to{i}") == F.col(f"__of{i}") for i in range(len(links))])
            paths = here.select(*ups, *[f"__key{i}" for i in range(len(own))], "__id", "__flagged")
            wanted = {titles[lv.name]: None}
            if is_leaf and flag is not None:
                wanted[titles["flag"]] = F.col("__flagged")
            below = counted(distinct_bitmaps(paths, ups, F.col("__id"), wanted), ups, list(wanted))
            rows = rows.join(below, match, "left").drop(*ups)
        picked = self._pick(columns, upto=at)
        return rows.select(
            *[_ref(source).alias(out) for out, source in picked.items()],
            *[F.coalesce(_ref(out), F.lit(0)).alias(out) for out in titles.values()],
        )

    # --- parts -----------------------------------------------------------

    def _at(self, level: str) -> int:
        return next(i for i, lv in enumerate(self.levels) if lv.name == level)

    def _keys(self, at: int) -> list[str]:
        lv = self.levels[at]
        return [f"{lv.name}.{k}" for k in lv.keys]

    def _named(self, level: Level, df: DataFrame | None = None) -> DataFrame:
        df = level.df if df is None else df
        return df.select(*[_ref(c).alias(f"{level.name}.{c}") for c in df.columns])

    def _link(self, at: int) -> list[Column]:
        lv = self.levels[at]
        return [
            _ref(f"{lv.name}.{p}") == _ref(k) for p, k in zip(lv.parents, self._keys(at - 1), strict=True)
        ]

    def _down_to(self, at: int) -> DataFrame:
        """Inner joins from the root to the level at `at`: each level, as the left side, meets all above it."""
        while len(self._chains) <= at:
            i = len(self._chains)
            rows = self._named(self.levels[i])
            if i > 0:
                rows = rows.join(self._chains[i - 1], self._link(i))
            self._chains.append(rows)
        return self._chains[at]

    def _counts_below(self, at: int, flag: Column | None) -> DataFrame:
        """One row per key of the level at `at` that has children."""
        below: DataFrame | None = None
        for lv in reversed(self.levels[at + 1 :]):
            is_leaf = lv is self.levels[-1]
            flagged = flag if is_leaf and flag is not None else F.lit(False)
            whole = reduce(lambda a, b: a & b, [_ref(c).isNotNull() for c in (*lv.parents, *lv.keys)])
            rows = lv.df.filter(whole).select(
                *[_ref(p).alias(f"__up{i}") for i, p in enumerate(lv.parents)],
                *[_ref(k).alias(f"__key{i}") for i, k in enumerate(lv.keys)],
                flagged.alias("__flagged"),
            )
            up = [f"__up{i}" for i in range(len(lv.parents))]
            own = [f"__key{i}" for i in range(len(lv.keys))]
            if not lv.unique:
                rows = rows.groupBy(*up, *own).agg(F.max("__flagged").alias("__flagged"))
            counted = [F.count(F.lit(1)).alias(f"__n_{lv.name}")]
            if below is None:
                counted.append(F.count_if(F.col("__flagged")).alias("__n_flag"))
            else:
                lower = below.select(
                    *[F.col(f"__up{i}").alias(f"__low{i}") for i in range(len(own))],
                    *[c for c in below.columns if c.startswith("__n_")],
                )
                match = [F.col(k) == F.col(f"__low{i}") for i, k in enumerate(own)]
                rows = rows.join(lower, match, "left")
                counted += [
                    F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
                    for c in lower.columns
                    if c.startswith("__n_")
                ]
            below = rows.groupBy(*up).agg(*counted)
        if below is None:
            raise ValueError("the last level has nothing below it to count")
        return below

    def _titles(self, at: int, flag: Column | None, counts: Mapping[str, str] | None) -> dict[str, str]:
        given = counts or {}
        titles = {lv.name: given.get(lv.name, f"n_{lv.name}") for lv in self.levels[at + 1 :]}
        if flag is not None:
            titles["flag"] = given.get("flag", "n_flagged")
        return titles

    def _pick(self, columns: Mapping[str, str] | None, upto: int | None = None) -> dict[str, str]:
        """Output name -> `level.column`; by default every column under its own name."""
        if columns is not None:
            return dict(columns)
        picked: dict[str, str] = {}
        for lv in self.levels[: None if upto is None else upto + 1]:
            for c in lv.df.columns:
                if c in picked:
                    raise ValueError(f"several levels have a column {c}; pass `columns`")
                picked[c] = f"{lv.name}.{c}"
        return picked

    def _show(
        self, rows: DataFrame, columns: Mapping[str, str] | None, order_by: Iterable[str]
    ) -> DataFrame:
        """Sort by any column, shown or not, then keep the shown ones."""
        if columns is None:
            here = {c.split(".", 1)[0] for c in rows.columns}
            upto = max(i for i, lv in enumerate(self.levels) if lv.name in here)
            columns = self._pick(None, upto)
        order = [_ref(c).asc_nulls_last() for c in order_by]
        if order:
            rows = rows.orderBy(*order)
        return rows.select(*[_ref(source).alias(out) for out, source in columns.items()])
