"""Near duplicates by SimHash, compared exactly in tiles.

Distinct fingerprints are gathered into tiles by the bit counts of their parts.
Two fingerprints whose part counts differ by more than the radius in total
differ in more bits than that, so only tiles of neighbouring counts meet. Within
a pair of tiles numpy compares everything: exclusive-or, then bit counts. A pair
of tiles hands on one star per connected group instead of all links.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.llm.common import connected, q, raw, small_batches, text_of, unused

SHINGLE = 3
RADIUS = 3
SEED = 42
# The 64 bits are counted in so many parts, and a tile holds about so many fingerprints.
_PARTS = 4
_TILE = 1024


def simhash(text: bytes) -> int:
    """The fingerprint of one whole text."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):  # a very long text in steps
        part = hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for batch in batches:
        prints = pa.array([simhash(t) for t in raw(batch.column(1))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, print`: the 64 bits as a long."""
    kind = docs.select(q(id_col)).schema[0].dataType.simpleString()
    slim = docs.select(q(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(_fingerprints, f"doc_id {kind}, print long")


def _offsets(radius: int, parts: int) -> list[list[int]]:
    """Steps between part counts within the radius, one of each pair of opposites."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius]
    return [list(s) for s in steps if s >= tuple(-x for x in s)]


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            for left, right in zip(batch.column(0), batch.column(1)):
                a, b = (x.values.to_numpy(zero_copy_only=False) for x in (left, right))
                # Unsigned: of a negative number numpy counts the bits of its absolute value.
                near = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= radius
                if near.any():
                    ends.append(_stars(a, b, near))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([e[k] for e in ends]) if ends else [], pa.int64()) for k in (0, 1)],
                names=["a", "b"],
            )

    return run


def _stars(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what `near` connects: every node with the hub of its group."""
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(rows, columns)]
    hub = np.arange(len(rows))
    while True:
        across = np.where(near, hub[:, None], len(rows)).min(axis=0)
        again = np.where(near, across[None, :], len(rows)).min(axis=1)
        if (again == hub).all():
            break
        hub = again
    nodes = np.concatenate([a[rows], b[columns]])
    return nodes, a[rows][np.concatenate([hub, across])]


def links(prints: DataFrame, radius: int = RADIUS, parts: int = _PARTS, tile: int = _TILE) -> DataFrame:
    """`(a, b)` over distinct `print`s: connects two of them if, and only if, a
    chain of fingerprints at `radius` or fewer differing bits does."""
    width = 64 // parts
    mask = -1 if width == 64 else (1 << width) - 1
    counts = [
        F.bit_count(F.shiftrightunsigned("print", i * width).bitwiseAND(F.lit(mask))).cast("int") for i in range(parts)
    ]
    binned = prints.select("print", F.array(*counts).alias("bin"))
    # At most (width + 1) ** parts rows, whatever the corpus.
    sizes = binned.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / tile).alias("n"))
    tiles = materialize(
        binned.join(F.broadcast(sizes), "bin")
        .groupBy("bin", F.pmod(F.xxhash64("print"), F.col("n")).alias("part"))
        .agg(F.collect_list("print").alias("prints")),
        "tiles",
    )
    steps = F.array(*[F.array(*map(F.lit, s)) for s in _offsets(radius, parts)])
    left = tiles.select("bin", "part", "prints", F.explode(steps).alias("step")).select(
        F.zip_with("bin", "step", lambda x, y: x + y).alias("bin"),
        F.col("part").alias("left_part"),
        F.col("prints").alias("left"),
        F.forall("step", lambda x: x == 0).alias("same"),
    )
    met = left.join(tiles.withColumnRenamed("prints", "right"), "bin").filter(
        ~F.col("same") | (F.col("left_part") <= F.col("part"))
    )
    return met.select("left", "right").mapInArrow(_compare(radius), "a long, b long").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, fingerprint, component_id, group_size`, one row per row of `docs`.

    `component_id` is the least id reachable over links of at most RADIUS bits
    (null only where all ids of the component are null), `group_size` counts
    the component's rows. Texts without a word have the fingerprint zero and
    link like any other; null counts as empty. Repeated rows share a
    fingerprint. Other columns of `docs` play no part.
    """
    small_batches(docs.sparkSession)
    slim = materialize(fingerprints(docs, id_col, text_col), "simhash")
    least = materialize(
        slim.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "prints"
    )
    edges = links(least.select("print"))
    roots = materialize(connected(edges, "simhash-stars"), "simhash-roots")
    classes = least.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", "copies", F.coalesce("root", "print").alias("root")
    )
    totals = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("group_size"))
    named = materialize(classes.select("print", "root").join(totals, "root").drop("root"), "simhash-classes")
    return slim.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "group_size"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component, the document with the least id.

    Rows that share an id are one document and stay or go together; so are all
    rows with a null id, which stay only in a component without other ids.
    """
    found = near_duplicates(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    [own] = unused(docs, "own_id")
    stays = found.select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stays, q(id_col).eqNullSafe(q(own)), "left_semi")
