"""Near vectors by filters against every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from espalier.llm import spherical
from espalier.llm.queries import QUERIES
from tests.llm.conftest import SF, of

KINDS = "vec_id long, embedding array<float>, label int"


def sound(vector):
    return bool(vector) and all(x is not None and np.isfinite(x) for x in vector) and any(vector)


def by_hand(rows, cosine=spherical.COSINE):
    """vec_id, n_links, component_id, kept of every row, from all pairs."""
    links = [set() for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is not None and a == b and sound(v) and sound(w) and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (own, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((own, len(links[i]), least, own is not None and own == least))
    return sorted(out, key=repr)


def awkward(seed=1):
    dice = np.random.default_rng(seed)
    base = dice.standard_normal((12, 16))
    rows = []

    def add(vector, label, own=-1):
        rows.append((len(rows) if own == -1 else own, vector, label))

    for k, center in enumerate(base):
        for spread in (0, 0, 0.02, 0.05, 0.05, 0.1, 0.1, 0.2, 0.2):  # equal ones, chains, near the bound
            add([float(np.float32(x)) for x in center + spread * dice.standard_normal(16)], k % 3)
        add([float(np.float32(x * 1e30)) for x in center], k % 3)  # as long as you like
        add([float(-x) for x in center.astype(np.float32)], k % 3)
        add([float(x) for x in center.astype(np.float32)], None)
        add([float(x) for x in center.astype(np.float32)], 7)
    for odd in (None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 3, [2.0] * 3, [1.0], [5.0], [-1.0], [1e-40] * 16, [1.0] * 16, [-0.0, 1.0, 0.0], [0.0, 1.0, -0.0]):
        add(odd, 1)
        add(odd, 1)
    add(rows[0][1], 0, own=None)
    add(rows[0][1], 0, own=0)
    add([0.5] * 9, 1, own=None)
    dice.shuffle(rows := list(rows))
    return [(None if r[0] is None else int(r[0]), r[1], r[2]) for r in rows]


@pytest.mark.parametrize("tile", [3, 256])
def test_awkward_rows(spark, tile):
    rows = awkward()
    table = spark.createDataFrame(rows, KINDS).repartition(3)
    clashing = table.select("*", *[F.lit("x").alias(c) for c in "node copies dim at part parts links root least filters left right same a b n kept n_links".split()])
    hand = by_hand([tuple(r) for r in table.collect()])
    assert sum(r[1] for r in hand) > 300
    for given in (table, clashing):
        assert of(spherical.near_vectors(given, tile=tile)) == hand


def test_no_rows(spark):
    assert spherical.near_vectors(spark.createDataFrame([], KINDS)).count() == 0


@pytest.mark.parametrize("dim, vectors", [(64, 5_000), (64, 10_000_000), (384, 100_000), (16, 100_000), (3, 1_000)])
def test_pairs_at_the_bound_share_a_filter(dim, vectors):
    dice = np.random.default_rng(3)
    filters = spherical.Filters(dim, vectors)
    one = spherical._unit(dice.standard_normal((1000, dim)))
    across = dice.standard_normal((1000, dim))
    across = spherical._unit(across - (across * one).sum(axis=1, keepdims=True) * one)
    two = 0.98 * one + np.sqrt(1 - 0.98**2) * across
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(filters.lists(one), filters.lists(two))]
    assert np.mean(met) >= 0.997


def test_decoded_lists_hold_every_filter_passed():
    filters = spherical.Filters(24, 3000)
    some = spherical._unit(np.random.default_rng(4).standard_normal((50, 24)))
    for at in (0, 3):
        sums = filters.turned(some, at)
        every = sums[0]
        for p in sums[1:]:
            every = (every[:, :, None] + p[:, None, :]).reshape(len(some), -1)
        row, index, best = filters.passed(some, at)
        hand = np.nonzero(every >= filters.bound)
        assert set(zip(row, index - at * filters.count)) == set(zip(*hand))
        assert np.allclose(best, every.max(axis=1))


def test_query_equals_every_pair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op12_embedding_near_dedup"](spark, SF)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert of(got) == by_hand(rows)


def test_crowds_of_near_vectors(spark):
    """Some of the links of a crowd are near the bound; every one counts once."""
    dice = np.random.default_rng(5)
    center = dice.standard_normal(32)
    rows = [(i, [float(np.float32(x)) for x in center + 0.13 * dice.standard_normal(32)], 1) for i in range(300)]
    hand = by_hand(rows)
    assert 2_000 < sum(r[1] for r in hand) < 80_000
    assert of(spherical.near_vectors(spark.createDataFrame(rows, KINDS), tile=32)) == hand
