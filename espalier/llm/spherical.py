"""Near-duplicate vectors by spherical-cap filters with product codes.

A filter is a direction; a vector passes those with which its inner product
reaches a threshold. Directions are a random product code: the space is turned
at random and cut into blocks, each block has a small list of random directions,
and a filter takes one of each list. So few block products are computed, and the
list of all passing filters is decoded from them block by block, with the best
that later blocks can add as the bound.

Vectors that pass a common filter meet and are verified. A vector is done with a
round that has a filter so near to it that a neighbour passes too, but for a
chance of about one in a thousand at the very bound of similarity, and goes on
to the next round, which turns the space anew, otherwise. Of two near vectors,
the first to be done meets the other in that round, which both take part in.
Those that are never done are compared with each other.

In the tile of a filter, a pair counts only where no earlier filter is common to
both, so each link is counted once and no list of pairs is needed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.llm.common import connected, q
from espalier.llm.simhash import _stars as stars

COSINE = 0.98
# Filters that a vector passes in a round, on average over all turns. A vector is
# done when one of them would still be passed after a fall by DEEP standard
# deviations; the last round is followed by LAST, a filter that all who are left pass.
TARGET = 8
DEEP = 3.0
ROUNDS = 32
LAST = -1
# What it costs to send a vector to a filter, in comparisons of two vectors.
_SENDING = 64
_TRIED = 256
_MOST_CODES = 1024
_TILE = 256
_AT_ONCE = 128
_SEED = 42


def tails(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products, ascending, and the share of the unit sphere that reaches each in a fixed direction."""
    at = np.linspace(-1, 1, (1 << 16) + 1)[1:-1]
    weight = np.exp((dim - 3) / 2 * np.log1p(-at * at))
    return at, np.cumsum(weight[::-1])[::-1] / weight.sum()


class Filters:
    """The filters of every round for vectors of one length, `vectors` of which may meet.

    Their number is the cheapest by expected work: many filters gather few
    strangers each, but neighbours seldom agree on a narrow one, so more rounds
    are needed. How many vectors a round is enough for is tried on random ones."""

    def __init__(self, dim: int, vectors: int, cosine: float = COSINE):
        self.dim = max(dim, 8)  # shorter vectors are padded with zeros
        at, share = tails(self.dim)
        some = _unit(np.random.default_rng(_SEED).standard_normal((_TRIED, dim)))
        options = []
        for wanted in (64 << k for k in range(0, 40, 2)):
            self.blocks = next(m for m in range(2, 9) if wanted ** (1 / m) <= _MOST_CODES or m == min(8, self.dim // 2))
            self.codes = min(_MOST_CODES, int(np.ceil(wanted ** (1 / self.blocks))))
            self.count = self.codes**self.blocks
            self.bound = float(at[np.searchsorted(-share, -TARGET / self.count)])
            # A neighbour's product: a little less, and a random part across.
            spread = np.sqrt((1 - cosine * cosine) * (1 - self.bound**2) / (self.dim - 1))
            self.deep = (self.bound + DEEP * spread) / cosine
            done = (sum(p.max(axis=1) for p in self.turned(some, 0)) >= self.deep).mean()
            left = (1 - done) ** ROUNDS
            rounds = (1 - left) / done if done else ROUNDS
            work = rounds * TARGET * (_SENDING + vectors * TARGET / self.count) + left * left * vectors
            options.append((work, self.blocks, self.codes, self.count, self.bound, self.deep))
        _, self.blocks, self.codes, self.count, self.bound, self.deep = min(options)

    def turned(self, vectors: np.ndarray, at: int) -> list[np.ndarray]:
        """Per block, the inner products with its directions, in the turn of a round."""
        cuts = np.array_split(np.arange(self.dim), self.blocks)
        turn, lists = _round(self.dim, self.blocks, self.codes, at)
        moved = vectors @ turn[: vectors.shape[1]]
        return [moved[:, c] @ codes.T for c, codes in zip(cuts, lists)]

    def passed(self, vectors: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter) for all filters of a round that the unit vectors pass, and the best product of each row."""
        rows, indexes, bests = [], [], []
        for first in range(0, len(vectors), _AT_ONCE):
            products = self.turned(vectors[first : first + _AT_ONCE], at)
            best = [p.max(axis=1) for p in products]
            row = np.arange(len(products[0]))
            index, sums = np.zeros(len(row), np.int64), np.zeros(len(row))
            for k, p in enumerate(products):
                need = self.bound - sums - sum((b[row] for b in best[k + 1 :]), np.zeros(len(row)))
                i, code = np.nonzero(p[row] >= need[:, None])
                sums, index, row = sums[i] + p[row[i], code], index[i] * self.codes + code, row[i]
            rows.append(row + first)
            indexes.append(index)
            bests.append(sum(best))
        return np.concatenate(rows), np.concatenate(indexes) + at * self.count, np.concatenate(bests)

    def lists(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Per unit vector, the ascending numbers of all the filters it passes."""
        found, waiting = [[] for _ in vectors], np.arange(len(vectors))
        for at in range(ROUNDS):
            if not len(waiting):
                break
            row, index, best = self.passed(vectors[waiting], at)
            order = np.lexsort((index, row))
            cuts = np.searchsorted(row[order], np.arange(1, len(waiting)))
            lists = np.split(index[order], cuts)
            for v, own in zip(waiting, lists):
                found[v].append(own)
            waiting = waiting[best < self.deep]
        for v in waiting:
            found[v].insert(0, np.array([LAST]))
        return [np.concatenate(f) for f in found]


@lru_cache(maxsize=64)
def _round(dim: int, blocks: int, codes: int, at: int) -> tuple[np.ndarray, list[np.ndarray]]:
    dice = np.random.default_rng([_SEED, dim, blocks, codes, at])
    turn, upper = np.linalg.qr(dice.standard_normal((dim, dim)))
    turn *= np.sign(np.diag(upper))  # else the turns aren't evenly spread
    lists = []
    for c in np.array_split(np.arange(dim), blocks):
        some = dice.standard_normal((codes, len(c)))
        lists.append(some / np.linalg.norm(some, axis=1, keepdims=True) * np.sqrt(len(c) / dim))
    return turn, lists


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@lru_cache(maxsize=16)
def filters_for(dim: int, vectors: int, cosine: float) -> Filters:
    return Filters(dim, vectors, cosine)


def _decoded(vectors: int, cosine: float):
    """Rows (…, embedding) with the filters that the vector passes."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = np.diff(column.offsets.to_numpy())
            values, starts = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
            lists: list = [None] * len(column)
            for dim in np.unique(sizes).tolist():
                filters = filters_for(dim, vectors, cosine)
                rows = np.flatnonzero(sizes == dim)
                for some in np.array_split(rows, -(-len(rows) // 1024)):
                    found = filters.lists(_unit(values[starts[some][:, None] + np.arange(dim)]))
                    for i, own in zip(some.tolist(), found):
                        lists[i] = own
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "filters"]
            )

    return run


# --- tiles -----------------------------------------------------------------------


class _Tiles:
    """A column of tiles: lists of (node, copies, embedding, filters)."""

    def __init__(self, column: pa.Array):
        self.ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        inside = column.flatten()
        self.nodes, self.copies = (inside.field(k).to_numpy() for k in (0, 1))
        self.vectors, self.filters = inside.field(2), inside.field(3)

    def rows(self, i: int) -> slice:
        return slice(int(self.ends[i]), int(self.ends[i + 1]))

    def units(self, rows: slice) -> np.ndarray:
        some = self.vectors.slice(rows.start, rows.stop - rows.start)
        return _unit(some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1))

    def earlier(self, rows: slice, picked: np.ndarray, than: int) -> list[np.ndarray]:
        some = self.filters.slice(rows.start, rows.stop - rows.start).take(pa.array(picked))
        return [own[own < than] for own in (x.values.to_numpy() for x in some)]


def _met_before(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether two rows have a filter in common."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    marks = []
    for lists in (left, right):
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        values = np.concatenate(lists)
        held = np.isin(values, common)
        mark = np.zeros((len(lists), len(common)), np.float32)
        mark[row[held], np.searchsorted(common, values[held])] = 1
        marks.append(mark)
    return marks[0] @ marks[1].T > 0


def _compared(cosine: float):
    """Tiles of one filter: `a, null, n` for a node with n new links, `a, b, 0` for stars of linked nodes."""

    def run(batches):
        for batch in batches:
            left, right = _Tiles(batch.column(1)), _Tiles(batch.column(2))
            a, b, n = [], [], []
            for i, (at, same) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                rows, others = left.rows(i), right.rows(i)
                near = left.units(rows) @ right.units(others).T >= cosine
                if same:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                some, more = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                new = near[np.ix_(some, more)] & ~_met_before(left.earlier(rows, some, at), right.earlier(others, more, at))
                if not new.any():
                    continue
                one, two = left.nodes[rows][some], right.nodes[others][more]
                counted = [(one, new @ right.copies[others][more])]
                if not same:
                    counted.append((two, left.copies[rows][some] @ new))
                for nodes, links in counted:
                    a.append(nodes)
                    b.append(np.full(len(nodes), -1))
                    n.append(links)
                nodes, hubs = stars(one, two, new)
                a.append(nodes)
                b.append(hubs)
                n.append(np.zeros(len(nodes), np.int64))
            a, b, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=b < 0), pa.array(n, pa.int64())], names=["a", "b", "n"]
            )

    return run


def _tiles(coded: DataFrame, tile: int) -> DataFrame:
    """`at, left, right, same`: the pairs of tiles of every filter that two vectors pass.

    Filters are counted on slim rows first, so vectors only travel to where
    they meet others; a crowded filter is cut into tiles of about `tile` rows."""
    entries = coded.select("node", "label", "dim", F.explode("filters").alias("at"))
    crowds = entries.groupBy("label", "dim", "at").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"), F.count(F.lit(1)).alias("n"))
    shared = materialize(crowds.filter("n > 1").drop("n"), "caps-shared")
    meeting = entries.join(shared, ["label", "dim", "at"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    member = F.struct("node", "copies", "embedding", "filters")
    place = ["label", "dim", "at", "part"]
    tiles = materialize(
        meeting.select("node", "at", "parts", "part")
        .join(coded, "node")
        .groupBy(*place, "parts")
        .agg(F.collect_list(member).alias("left")),
        "caps-tiles",
    )
    alone = tiles.filter("parts = 1").select("at", "left", F.col("left").alias("right"), F.lit(True).alias("same"))
    many = tiles.filter("parts > 1")
    other = many.select("label", "dim", "at", F.col("part").alias("other"), F.col("left").alias("right"))
    pairs = many.join(other, ["label", "dim", "at"]).filter("part <= other")
    return alone.unionByName(pairs.select("at", "left", "right", (F.col("part") == F.col("other")).alias("same")))


def _sound(vector: Column) -> Column:
    """Not null, not zero, and without components that are null, infinite or no number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    tile: int = _TILE,
) -> DataFrame:
    """`vec_id, n_links, component_id, kept`, one row per row of `vectors`.

    Vectors link when their labels are equal and not null, they have as many
    components, and their cosine, in double precision, is `cosine` or more.
    `n_links` counts the other rows linked directly, `component_id` is the least
    id reachable (null only where all ids of the component are), `kept` tells
    whether it is the row's own; of a null id it is false. Vectors that are null,
    empty or zero or hold a component that is null or not finite link with
    nothing. Equal vectors are compared once and count as often as they occur;
    rows that repeat an id are rows of their own. An empty table gives no rows;
    other columns play no part.

    A link can only be missed where no filter of the rounds that both vectors
    take part in is passed by both; the share is measured in the tests.
    """
    column = q(vector_col)
    if vectors.select(column).schema[0].dataType.simpleString() != "array<float>":
        column = column.cast("array<double>")
    slim = vectors.select(q(id_col).alias("vec_id"), q(label_col).alias("label"), column.alias("embedding"))
    sound = F.col("label").isNotNull() & _sound(F.col("embedding"))
    classes = materialize(
        slim.filter(sound)
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "caps-vectors",
    )
    most = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    plain = classes.select("node", "label", F.size("embedding").alias("dim"), "copies", "embedding")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    coded = materialize(plain.mapInArrow(_decoded(most, cosine), f"{kinds}, filters array<bigint>"), "caps-filters")
    found = materialize(
        _tiles(coded, tile).select("at", "left", "right", "same").mapInArrow(_compared(cosine), "a bigint, b bigint, n bigint"),
        "caps-links",
    )
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    edges = found.filter("b is not null and a <> b").select("a", "b").distinct()
    roots = materialize(connected(edges, "caps-stars"), "caps-roots")
    named = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answers = materialize(
        named.join(least, "root").select(
            "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
        ),
        "caps-classes",
    )
    linked = slim.filter(sound).join(answers, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = slim.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
