"""Mixing and fingerprints: invariants and brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from espalier.llm import mixing, sketch
from espalier.llm.queries import QUERIES
from tests.llm.conftest import SF, of


def n_words(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_by_hand(rows):
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += n_words(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free, left = set(order), Fraction(sum(sizes.values()))
    out = {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] >= 3 * sizes[s] * total}
        if not over:
            break
        for s in over:
            out[s] = Fraction(3 * sizes[s])
            left -= out[s]
        free -= over
        if not free:
            break
    return sizes, out | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}


def holds(found, rows):
    sizes, targets = targets_by_hand(rows)
    taken = defaultdict(int)
    assert sorted((r.doc_id, r.size) for r in found if r.doc_id is not None) == sorted(
        (d, n_words(t)) for d, t, *_ in rows if d is not None
    )
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(targets[r.source]), rel=1e-12, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        assert r.epochs * r.size >= r.taken >= (r.epochs - 1) * r.size
        taken[r.source] += r.taken
    assert taken == {s: int(t) for s, t in targets.items()}


def test_mix(docs, rows):
    found = mixing.mix(docs).collect()
    holds(found, rows)
    assert of(mixing.mix(docs.repartition(2))) == sorted(map(tuple, found), key=repr)  # reruns agree


def test_mix_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    holds(mixing.mix(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])
    assert QUERIES["op7_mixing"](spark, SF).count() == docs.count()


def test_mix_edges(docs, none, clashing, spark):
    assert mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0
    assert of(mixing.mix(clashing), "doc_id", "taken") == of(mixing.mix(docs), "doc_id", "taken")
    mixed = mixing.mixture(clashing)
    assert mixed.columns == clashing.columns
    wanted = sum(r.epochs for r in mixing.mix(docs.dropDuplicates()).collect())
    assert mixing.mixture(docs.dropDuplicates()).count() == wanted
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(empty).collect()} == {(0.0, 0)}


def test_mix_is_native(docs):
    for df in (mixing.mix(docs), sketch.compare_with_next(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# --- fingerprints ----------------------------------------------------------------


def edited_by_hand(rows):
    """For rows that are distinct in id and text, with ids."""
    rows = sorted(rows)
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        part = len(text) // 4
        out[doc_id] = (len(text), text[: len(text) - part] + following[:part])
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(spark, rows):
    own = {r[0]: r[1] for r in rows if r[0] is not None}
    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(3)
    hand = edited_by_hand(list(own.items()))
    by_text = {}
    found = sketch.compare_with_next(docs).collect()
    assert len(found) == len(own)
    for r in found:
        n, text = hand[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(text.encode()).hexdigest())
        assert by_text.setdefault(own[r.doc_id] or "", r.fingerprint) == r.fingerprint
        assert by_text.setdefault(text, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint != "" or own[r.doc_id] == text)


def test_fingerprints_estimate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r.doc_id: r.text for r in docs.collect()}
    hand = edited_by_hand(list(own.items()))
    off = []
    for r in sketch.compare_with_next(docs).collect():
        a, b = shingles(own[r.doc_id]), shingles(hand[r.doc_id][1])
        if len(a | b) >= 400:
            off.append(abs(r.near_edited - len(a & b) / len(a | b)))
    assert len(off) > 300 and sum(off) / len(off) < 0.06


def test_fingerprints_of_short_texts(spark):
    """The fewer words, the rougher: without a kept hash nothing is claimed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r.doc_id: r.text or "" for r in docs.collect()}
    hand = edited_by_hand(list(own.items()))
    off = {}
    for r in sketch.compare_with_next(docs).collect():
        a, b = shingles(own[r.doc_id]), shingles(hand[r.doc_id][1])
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert (r.n_kept, r.n_kept_edited) == (len(r.fingerprint) / 16, len(r.edited_fingerprint) / 16)
        if own[r.doc_id] == hand[r.doc_id][1]:
            assert r.near_edited == r.held_by_edited == 1.0
        elif not r.n_kept and not r.n_kept_edited:
            assert (r.near_edited, r.held_by_edited) == (0.0, 1.0)
        off.setdefault(min(len(a), 400) // 100 * 100, []).append(abs(r.near_edited - true))
    mean = {size: sum(x) / len(x) for size, x in off.items()}
    assert len(off[0]) > 30 and mean[0] < 0.2 and mean[100] < 0.1 and mean[400] < 0.05, mean


def test_sketches_are_a_quarter_of_the_hashes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept, every = 0, 0
    for r in sketch.compare_with_next(docs).select("doc_id", "n_kept").join(docs, "doc_id").collect():
        kept, every = kept + r.n_kept, every + len(shingles(r.text))
    assert 0.24 < kept / every < 0.26
    hashes = docs.select(sketch.sketch(F.col("text")).alias("s")).agg(F.max(F.array_max("s"))).first()[0]
    assert hashes < -(2**63) + 2**64 // sketch.SCALE


@pytest.mark.parametrize("scale", [1, 2, 8])
def test_short_sketches_merge(spark, scale):
    """A short text within a longer one: the merged sketch is the sketch of the longer."""
    texts = [(f"w{i} x{i} y{i} z{i} v{i} w", f"w{i} x{i} y{i} z{i} v{i} w and more of u{i}") for i in range(50)]
    row = spark.createDataFrame(texts, "x string, y string")
    a, b = (sketch.sketch(F.col(c), scale=scale) for c in "xy")
    assert row.filter(sketch.merge(a, b) != b).count() == 0
    assert scale > 1 or row.filter(sketch.containment(a, b) < 1).count() == 0


def test_sketches_merge(spark):
    row = spark.range(1).select(
        F.lit("a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3).alias("x"), F.lit("one two three " * 90).alias("y")
    )
    a, b = sketch.sketch(F.col("x"), scale=2), sketch.sketch(F.col("y"), scale=2)
    both = row.select(a.alias("a"), b.alias("b"), sketch.merge(a, b).alias("m"))
    got = both.select(sketch.containment(F.col("a"), F.col("m")), sketch.containment(F.col("b"), F.col("m"))).first()
    assert tuple(got) == (1.0, 1.0)


def test_fingerprints_edges(docs, rows, none, clashing, spark):
    assert sketch.compare_with_next(none).count() == 0
    found = of(sketch.compare_with_next(docs))
    assert len(found) == len(rows)
    assert of(sketch.compare_with_next(clashing)) == found
    lone = spark.createDataFrame([(5, "one two three four five six seven eight")], "doc_id long, text string")
    assert sketch.compare_with_next(lone).first().near_next == 1.0
    assert QUERIES["op9_document_fingerprints"](spark, SF).count() == 200
