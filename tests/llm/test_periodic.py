"""Runs of repeated words against a search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from espalier.llm import periodic
from espalier.llm.queries import QUERIES, with_repeats
from tests.llm.conftest import SF, of


def by_hand(words, shortest=6, power=4):
    """(start, length, period) of every run, trying each period on every word."""
    found = {}
    for d in range(1, len(words) // power + 1):
        i = 0
        while i + d < len(words):
            j = i
            while j + d < len(words) and words[j] == words[j + d]:
                j += 1
            if j + d - i >= max(shortest, power * d):
                found.setdefault((i, j + d), d)  # periods ascend: the first is the smallest
            i = max(j, i + 1)
    return sorted(((a, b - a, d) for (a, b), d in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for a, n, d in runs for i in range(a + d, a + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def edited(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def answer(doc_id, words):
    runs = by_hand(words)
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{a},{n},{d}\n" for a, n, d in runs)
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=12))
def test_runs_equal_a_search_of_every_period(parts):
    words = [w for piece, times in parts for w in piece * times]
    for shortest, power in ((6, 4), (1, 3), (9, 5)):
        got = periodic.runs_of(np.array(words, np.int64), len(words), shortest, power)
        assert [(a, b - a, d) for a, b, d in got.tolist()] == by_hand(words, shortest, power)


def test_too_few_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(9, np.int64), 9, power=2)


def test_convolution_finds_every_occurrence():
    dice = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        ids = dice.integers(0, 2, 40 * size)
        ids[5 * size :] = np.tile(ids[: size + size // 3 + 1], 40)[: 35 * size]
        starts = np.arange(0, len(ids) - size, size)
        at, far = periodic.occurrences(ids, starts, size)
        hand = {(s, d) for s in starts.tolist() for d in range(size, 2 * size) if s + d + size <= len(ids) and (ids[s : s + size] == ids[s + d : s + d + size]).all()}
        assert set(zip(at.tolist(), far.tolist())) == hand


def test_hashes_that_meet_do_no_harm(monkeypatch):
    """With hashes that are always equal, every run is still found word by word."""
    monkeypatch.setattr(periodic._Stretches, "_agree", lambda self, a, far, length: np.ones(len(a), bool))
    words = [0, 1] * 4 + [2] + [3] * 9 + [4, 5, 6] * 5
    assert [(a, b - a, d) for a, b, d in periodic.runs_of(np.array(words), len(words)).tolist()] == by_hand(words)


@pytest.mark.parametrize("words", [[0] * 200_000, [0, 1] * 100_000, ([0] * 999 + [1]) * 200])
def test_long_repeats_take_no_more_than_seconds(words):
    got = periodic.runs_of(np.array(words), len(words))
    assert (0, len(words)) in {(a, b) for a, b, _ in got.tolist()}


def test_awkward_rows(docs, rows, clashing, none):
    def hand(row):
        words = (row[1] or "").encode().split()
        return row[0], by_hand(words), collapsed(words, by_hand(words)).decode()

    short = [r for r in rows if len((r[1] or "").split()) < 1000 and r[0] != 10]
    want = sorted(map(hand, short), key=repr)
    keep = (F.length("text") < 9000) | F.col("text").isNull()
    for table in (docs, clashing):
        got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.word_runs(table.filter(keep)).collect()]
        assert sorted(got, key=repr) == want
    assert periodic.word_runs(none).count() == 0
    [long] = periodic.word_runs(docs.filter("doc_id = 7")).collect()
    assert [tuple(r) for r in long.runs] == [(0, 30_000, 1)] and long.collapsed == "word"


def test_white_space_is_ascii_only(spark):
    text = "\x0b\x0ca a  a \ta \na \ra  a  b\x1c \x85 "
    [row] = periodic.word_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(1, 6, 1)] and row.collapsed == "a a  b\x1c \x85"


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hand = sorted((answer(r.doc_id, edited(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    got = QUERIES["op13_periodic_runs"](spark, SF)
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert of(got) == hand
    assert sum(r[1] for r in hand) > 10


def test_edited_texts(spark, docs):
    dice = random.Random(2)
    more = [(i, " ".join(dice.choice("abcdefgh") for _ in range(dice.randint(0, 40)))) for i in range(300)]
    table = spark.createDataFrame(more, "doc_id long, text string").unionByName(docs.select("doc_id", "text").filter("length(text) < 5000"))
    got = [(r.doc_id, (r.text or "").encode().split()) for r in with_repeats(table).collect()]
    assert sorted(got, key=repr) == sorted(((r.doc_id, edited(r.doc_id, r.text)) for r in table.collect()), key=repr)
