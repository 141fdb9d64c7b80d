"""Exact, line and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from espalier.llm import exact_dedup, line_dedup, simhash
from espalier.llm.common import connected
from espalier.llm.queries import QUERIES
from tests.llm.conftest import SF, of

SPACE = " \t\n\x0b\x0c\r"
LATE = 1 << 62


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- exact -----------------------------------------------------------------


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for text, members in groups.items():
        ids = [m[3] for m in members if m[3] is not None]
        first = min(members)
        for m in members:
            # Of rows with one id it is open which one stays.
            out.append((m[3], min(ids, default=None), len(members), m[3] == first[3], sha(text)))
    return out


@pytest.mark.parametrize("counters", [1, 7, 1023])
def test_exact_groups(docs, rows, counters):
    found = exact_dedup.duplicate_groups(docs, counters=counters)
    theirs = exact_by_hand(rows)
    plain = [c for c in found.columns if c != "kept"]
    assert of(found, *plain) == sorted([(a, b, n, d) for a, b, n, _, d in theirs], key=repr)
    assert found.filter("kept").select("text_sha256").distinct().count() == found.filter("kept").count()
    assert {(r.doc_id, r.text_sha256) for r in found.filter("kept").collect()} <= {(a, d) for a, _, _, k, d in theirs if k}


def test_exact_edges(docs, none, clashing):
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert of(exact_dedup.duplicate_groups(clashing), "doc_id", "keep_id", "group_size") == of(
        exact_dedup.duplicate_groups(docs), "doc_id", "keep_id", "group_size"
    )
    assert exact_dedup.deduplicate(clashing).columns == clashing.columns


def test_misra_gries_misses_no_frequent_digest(spark):
    ids = spark.range(0, 4000, 1, 13)
    digest = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    slim = ids.select(F.encode(digest, "UTF-8").alias("digest"))
    found = [bytes(r.digest) for r in exact_dedup.frequent_digests(slim, counters=15).collect()]
    assert b"hot" in found and len(found) <= 16


# --- lines -------------------------------------------------------------------


def lines_by_hand(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(table)
            if len(key) >= 10:
                holders[key].add(LATE if doc_id is None else doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(line.strip(SPACE).translate(table), set())
            if len(held) < 2 or min(held) == (LATE if doc_id is None else doc_id):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [None, 1 << 12])  # the small filters are full: everything is suspected
def test_lines(docs, rows, bits):
    found = line_dedup.dedup_lines(docs, bits=bits)
    assert of(found, "doc_id", "n_lines", "n_dropped", F.sha2("text", 256)) == lines_by_hand(rows)


def test_lines_edges(docs, none, clashing):
    assert line_dedup.dedup_lines(none).count() == 0
    found = line_dedup.dedup_lines(clashing)
    assert sorted(found.columns) == sorted({*clashing.columns, "n_lines", "n_dropped"})
    assert of(found, "doc_id", "text", "n_dropped") == of(line_dedup.dedup_lines(docs), "doc_id", "text", "n_dropped")


def test_merged_filters_hold_every_repeat():
    """Partial filters of two tasks: what both have seen is in the merged second filter."""
    bits = 1 << 12
    hashes = np.array([xxhash.xxh3_64_intdigest(str(i)) for i in range(100)], np.uint64)
    once = [np.zeros(bits // 8, np.uint8) for _ in range(2)]
    for packed in once:
        line_dedup._put(packed, line_dedup._bits_of(hashes, bits))
    assert line_dedup._holds(once[0] & once[1], line_dedup._bits_of(hashes, bits)).all()


# --- near duplicates ------------------------------------------------------------


def print_by_hand(text) -> int:
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if counts[bit] * 2 > len(shingles)) if shingles else 0


def near_by_hand(rows, radius=3):
    prints = [print_by_hand(r[1]) for r in rows]
    known = sorted(set(prints))
    parent = {p: p for p in known}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least, size = {}, defaultdict(int)
    for (doc_id, *_), p in zip(rows, prints):
        size[root(p)] += 1
        if doc_id is not None:
            least[root(p)] = min(least.get(root(p), doc_id), doc_id)
    return sorted(
        [(r[0], f"{p:016x}", least.get(root(p)), size[root(p)]) for r, p in zip(rows, prints)], key=repr
    )


def test_near(docs, rows):
    assert of(simhash.near_duplicates(docs)) == near_by_hand(rows)


def test_near_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert of(QUERIES["op4_simhash_near_dedup"](spark, SF)) == near_by_hand(rows)


@pytest.mark.parametrize("tile,parts", [(4, 4), (1024, 2), (3, 1)])
def test_links_connect_what_brute_force_connects(spark, tile, parts):
    dice = np.random.default_rng(1)
    base = dice.integers(0, 1 << 63, 12, dtype=np.int64)
    known = {int(b) for b in base}
    for b in base:  # chains: each one bit or more further
        x = int(b)
        for _ in range(20):
            x ^= 1 << int(dice.integers(0, 63))
            known.add(x)
    prints = spark.createDataFrame([(k,) for k in known], "print long")
    found = connected(simhash.links(prints, tile=tile, parts=parts))
    groups = defaultdict(set)
    for node, root in found.collect():
        groups[root].add(node)
    theirs = defaultdict(set)
    for k in sorted(known):
        near = {g for g in theirs if any((k ^ m).bit_count() <= 3 for m in theirs[g])}
        merged = {k}.union(*(theirs.pop(g) for g in near))
        theirs[min(merged)] = merged
    assert {r: g for r, g in groups.items()} == {r: g for r, g in theirs.items() if len(g) > 1}


def test_links_reach_over_the_sign_bit(spark):
    """Three bits apart, the highest among them; all 64 bits apart."""
    top = -(1 << 63)
    prints = spark.createDataFrame([(0b11000,), (top + 0b11011,), (5 << 40,), (~(5 << 40),)], "print long")
    assert of(simhash.links(prints).select(F.least("a", "b"), F.greatest("a", "b")).distinct()) == [(top + 0b11011, 0b11000)]


def test_near_edges(docs, none, clashing):
    assert simhash.near_duplicates(none).count() == 0
    assert of(simhash.near_duplicates(clashing)) == of(simhash.near_duplicates(docs))
    stay = simhash.one_of_each(clashing)
    assert stay.columns == clashing.columns
    ids = [r.doc_id for r in stay.collect()]
    found = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {i for i in ids} == found


@pytest.mark.parametrize("n", [2, 65])
def test_connected_chain(spark, n):
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert of(connected(chain)) == sorted([(i, 0) for i in range(n)], key=repr)
