"""Lines that several documents share, kept in the first document only.

Two Bloom filters of a fixed size are filled by one reading: one with all line
hashes, one with those met again. Partial filters merge in any order: a line of
two partial filters sets all its bits in both, so the bits common to any two
belong to the second filter. Only lines that the second filter reports leave
their document, to be confirmed by their SHA-256. A line that two documents
share is always reported; a false report costs one extra row and is dropped at
confirmation.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.durable import materialize
from espalier.llm.common import SPACES, q, raw, shuffle_partitions, small_batches, text_of, unused

SHORTEST = 10
# Bits of one filter: eight per line of the corpus, within these bounds. The
# upper one (64 MB) bounds what is broadcast; beyond it the filter reports more
# lines than need be, and the result stays the same.
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 29
_HASHES = 3
_CHUNKS = 512
_SPACES = SPACES.encode()


def _key(line: bytes) -> bytes | None:
    """The line's key, or None if it has fewer than SHORTEST code points."""
    key = line.strip(_SPACES).lower()  # of bytes: only A-Z change
    if len(key) < SHORTEST or len(key) < 4 * SHORTEST and len(key.decode(errors="replace")) < SHORTEST:
        return None
    return key


def _keys(text: bytes) -> dict[bytes, list[int]]:
    """Positions by key."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = _key(line)
        if key is not None:
            found.setdefault(key, []).append(i)
    return found


def _bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    first, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (first[:, None] + step[:, None] * np.arange(_HASHES, dtype=np.uint64)) & np.uint64(bits - 1)


def _holds(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    bits = packed[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)
    return (bits & 1).all(axis=1)


def _put(packed: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    np.bitwise_or.at(packed, flat >> np.uint64(3), np.uint8(1) << (flat & np.uint64(7)).astype(np.uint8))


def _partial_filters(bits: int):
    def run(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            met = [xxhash.xxh3_64_intdigest(k) for text in raw(batch.column(0)) for k in _keys(text)]
            hashes, counts = np.unique(np.array(met, np.uint64), return_counts=True)
            places = _bits_of(hashes, bits)
            _put(twice, places[(counts > 1) | _holds(once, places)])
            _put(once, places)
        width = bits // 8 // _CHUNKS
        rows = [(i, once[i * width : (i + 1) * width], twice[i * width : (i + 1) * width]) for i in range(_CHUNKS)]
        rows = [(i, zlib.compress(a.tobytes(), 1), zlib.compress(b.tobytes(), 1)) for i, a, b in rows if a.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))],
            names=["chunk", "once", "twice"],
        )

    return run


def _merge(batches):
    """Partial filters of a few chunks, in any order; holds one pair per chunk."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for chunk, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
            if chunk in held:
                one, two = held[chunk]
                held[chunk] = (one | a, two | b | (one & a))
            else:
                held[chunk] = (a, b)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(held), pa.int32()),
            pa.array([zlib.compress(two.tobytes(), 1) for _, two in held.values()], pa.binary()),
        ],
        names=["chunk", "twice"],
    )


def _suspects(twice, bits: int):
    def run(batches):
        packed = np.frombuffer(zlib.decompress(twice.value), np.uint8)
        for batch in batches:
            ids, hashes, rows = batch.column(0), batch.column(1), []
            found = [(i, k, p) for i, t in enumerate(raw(batch.column(2))) for k, p in _keys(t).items()]
            met = np.array([xxhash.xxh3_64_intdigest(k) for _, k, _ in found], np.uint64)
            again = np.flatnonzero(_holds(packed, _bits_of(met, bits))) if len(met) else []
            rows = [found[j] for j in again]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(at),
                    hashes.take(at),
                    pa.array([hashlib.sha256(r[1]).digest() for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                ],
                names=["key_id", "key_text", "line", "places"],
            )

    return run


_REBUILT = T.StructType().add("kept", T.StringType()).add("n_lines", T.LongType()).add("n_dropped", T.LongType())


@F.pandas_udf(_REBUILT)
def _rebuild(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
    rows = []
    for t, d in zip(text, drops):
        lines = t.split("\n")
        gone = set() if d is None else set(d.tolist() if hasattr(d, "tolist") else d)
        rows.append(
            ("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else t, len(lines), len(gone))
        )
    return pd.DataFrame(rows, columns=["kept", "n_lines", "n_dropped"])


def filter_bits(docs: DataFrame, text_col: str = "text") -> int:
    """A power of two with eight bits for each line, within the bounds."""
    text = text_of(text_col)
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * int(lines) - 1).bit_length()))


def repeated_lines_filter(docs: DataFrame, text_col: str, bits: int) -> bytes:
    """The second filter, packed and compressed: at most MOST_BITS of it, at any size."""
    chunks = (
        docs.select(text_of(text_col).alias("text"))
        .mapInArrow(_partial_filters(bits), "chunk int, once binary, twice binary")
        .repartition(shuffle_partitions(docs.sparkSession), "chunk")
        .mapInArrow(_merge, "chunk int, twice binary")
        .collect()
    )
    packed, width = np.zeros(bits // 8, np.uint8), bits // 8 // _CHUNKS
    for row in chunks:
        packed[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return zlib.compress(packed.tobytes(), 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """`docs` with the kept text, and `n_lines` and `n_dropped` of each.

    A line's key is the line without outer white space, A-Z lower-cased. A key
    of at least SHORTEST code points that two documents hold loses all its
    lines except in the document with the least id. Rows that share an id are
    one document here; null ids are one document too, and come last. A null
    text counts as empty, which is one empty line. Columns of `docs` that are
    named like a result are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bits = bits or filter_bits(docs, text_col)
    twice = spark.sparkContext.broadcast(repeated_lines_filter(docs, text_col, bits))
    key = [q(id_col).alias("key_id"), F.xxhash64(text_of(text_col)).alias("key_text")]
    kind = docs.select(q(id_col)).schema[0].dataType.simpleString()
    suspects = materialize(
        docs.select(*key, text_of(text_col).alias("text")).mapInArrow(
            _suspects(twice, bits), f"key_id {kind}, key_text long, line binary, places array<int>"
        ),
        "suspects",
    )
    some = F.count("key_id")
    seen = suspects.groupBy("line").agg(
        F.min("key_id").alias("first"),
        ((F.min("key_id") != F.max("key_id")) | ((some > 0) & (some < F.count(F.lit(1))))).alias("shared"),
    )
    # Stored, so that the join below has an exchange on either side and a line
    # that a third of the documents hold can be split.
    first = materialize(seen.filter("shared").drop("shared"), "shared-lines")
    drops = (
        suspects.join(first, "line")
        .filter(~F.col("key_id").eqNullSafe(F.col("first")))
        .groupBy("key_id", "key_text")
        .agg(F.flatten(F.collect_list("places")))
    )
    drop_id, drop_text, places, own_id, own_text, new = unused(docs, "drop_id", "drop_text", "drops", "own_id", "own_text", "new")
    drops = drops.toDF(drop_id, drop_text, places)
    keyed = docs.select("*", key[0].alias(own_id), key[1].alias(own_text))
    match = q(own_id).eqNullSafe(q(drop_id)) & (q(own_text) == q(drop_text))
    joined = keyed.join(drops, match, "left").withColumn(new, _rebuild(text_of(text_col), q(places)))
    counts = ("n_lines", "n_dropped")
    return joined.select(
        *[q(new)["kept"].alias(c) if c == text_col else q(c) for c in docs.columns if c.lower() not in counts],
        *[q(new)[c].alias(c) for c in counts],
    )
