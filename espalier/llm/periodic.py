"""Runs of words that repeat with a period, found by block convolution.

At every scale B, a power of two, a text is cut into blocks of B words. A run of
at least three periods q in [B, 2B) holds a whole block whose copy q words on
lies in the run as well. Where a block occurs again is read off one convolution:
the sum of squared differences of the block and each stretch of the window that
follows, by number-theoretic transforms, so in whole numbers without rounding.
Distances of the zeros are the periods to try; each is extended both ways to the
whole run. Only blocks all of whose words come back soon enough are convolved,
as no other block can occur again in its window.

The texts of a batch are searched together, with a word of its own after each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from espalier.llm.common import q, text_of

SHORTEST = 6
POWER = 4
# A prime with roots of unity of every order up to 2 ** 27, and a generator of
# its units. Products of two residues fit in 64 bits.
_PRIME = 15 * (1 << 27) + 1
_GENERATOR = 31
# Words of a batch that are searched together, and numbers convolved at once.
_TOGETHER = 1 << 18
_AT_ONCE = 1 << 20


# --- convolution ---------------------------------------------------------------


@lru_cache(maxsize=64)
def _turns(n: int, back: bool) -> np.ndarray:
    """The first n / 2 powers of an n-th root of unity, or of its inverse."""
    root = pow(_GENERATOR, (_PRIME - 1) // n, _PRIME)
    root = pow(root, -1, _PRIME) if back else root
    powers = np.ones(1, np.uint64)
    while len(powers) < n // 2:
        step = np.uint64(pow(root, len(powers), _PRIME))
        powers = np.concatenate([powers, powers * step % np.uint64(_PRIME)])
    return powers


def _forward(rows: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order."""
    p, half = np.uint64(_PRIME), rows.shape[1] // 2
    while half:
        parts = rows.reshape(len(rows), -1, 2, half)
        a, b = parts[:, :, 0], parts[:, :, 1]
        rows = np.stack([(a + b) % p, (a + p - b) * _turns(2 * half, False) % p], axis=2).reshape(rows.shape)
        half //= 2
    return rows


def _backward(rows: np.ndarray) -> np.ndarray:
    """Undoes `_forward`, bit-reversed order included."""
    p, n = np.uint64(_PRIME), rows.shape[1]
    half = 1
    while half < n:
        parts = rows.reshape(len(rows), -1, 2, half)
        a, b = parts[:, :, 0], parts[:, :, 1] * _turns(2 * half, True) % p
        rows = np.stack([(a + b) % p, (a + p - b) % p], axis=2).reshape(rows.shape)
        half *= 2
    return rows * np.uint64(pow(n, -1, _PRIME)) % p


def occurrences(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance): blocks of `size` words with no mismatch at a distance in [size, 2 size).

    `ids` are non-negative and below the prime. The sums are taken modulo the
    prime: a block that matches has a zero, and the rare other zero is refuted
    by the extension that follows.
    """
    p = np.uint64(_PRIME)
    padded = np.concatenate([ids, np.full(3 * size, ids.max(initial=0) + 1)]).astype(np.uint64)
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(padded * padded % p)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for some in np.array_split(starts, -(-len(starts) * 2 * size // _AT_ONCE) or 1):
        block, window = np.zeros((2, len(some), 2 * size), np.uint64)
        block[:, :size] = padded[some[:, None] + np.arange(size)[::-1]]
        window[:, :-1] = padded[some[:, None] + size + np.arange(2 * size - 1)]
        # Outputs from size - 1 on are untouched by the wrap of this cyclic product.
        product = _backward(_forward(block) * _forward(window) % p)[:, size - 1 : 2 * size - 1]
        at = some[:, None] + size + np.arange(size)
        own = squares[some + size] - squares[some]
        sums = (own[:, None] + squares[at + size] - squares[at]) % p
        row, far = np.nonzero(sums == 2 * product % p)
        found.append((some[row], far + size))
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


# --- runs ------------------------------------------------------------------------


class _Stretches:
    """How far two places of one sequence agree, by hashes of its prefixes.

    Equal stretches have equal hashes, so an answer is never too short; runs
    are compared word by word before they count.
    """

    def __init__(self, ids: np.ndarray):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.ids = ids
        self.powers = np.full(len(ids) + 1, 0xD6E8FEB86659FD93, np.uint64)
        self.powers[0] = 1
        self.powers = np.cumprod(self.powers)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * self.powers[:-1], dtype=np.uint64)])

    def _agree(self, a: np.ndarray, far: np.ndarray, length: np.ndarray) -> np.ndarray:
        here = (self.sums[a + length] - self.sums[a]) * self.powers[far]
        return here == self.sums[a + far + length] - self.sums[a + far]

    def around(self, at: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the end of the stretch with period `far` around `at`."""
        ahead = self._longest(lambda n: self._agree(at, far, n), len(self.ids) - at - far)
        behind = self._longest(lambda n: self._agree(at - n, far, n), at)
        return at - behind, at + far + ahead

    @staticmethod
    def _longest(agree, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = agree(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def exactly_around(self, at: int, far: int) -> tuple[int, int]:
        apart = np.flatnonzero(self.ids[:-far] != self.ids[far:])
        k = int(np.searchsorted(apart, at))
        first = int(apart[k - 1]) + 1 if k else 0
        return first, (int(apart[k]) if k < len(apart) else len(self.ids) - far) + far


def _within(known: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether some known run (start, end, period) holds [start, end)."""
    if not len(known):
        return np.zeros(len(start), bool)
    known = known[np.argsort(known[:, 0], kind="stable")]
    reach = np.maximum.accumulate(known[:, 1])
    k = np.searchsorted(known[:, 0], start, "right")
    return (k > 0) & (reach[k - 1] >= end)


def runs_of(ids: np.ndarray, longest: int, shortest: int = SHORTEST, power: int = POWER) -> np.ndarray:
    """All runs of a sequence as rows (start, end, smallest period), by start, then period.

    No run is over `longest` words. Scales ascend. What lies in a run that is
    known already can only show multiples of its period, so it isn't searched
    again: a text of one word costs no more than any other.
    """
    if power < 3:
        raise ValueError("a run must hold three periods at least")
    known = np.zeros((0, 3), np.int64)
    if not len(ids):
        return known
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), np.iinfo(np.int64).max)
    again = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    stretches, size = None, 1
    while max(shortest, power * size) <= longest:
        blocks = len(ids) // size
        starts = np.flatnonzero(gap[: blocks * size].reshape(-1, size).max(axis=1, initial=0) < 2 * size) * size
        starts = starts[~_within(known, starts, starts + 3 * size - 1)]
        if len(starts):
            stretches = stretches or _Stretches(ids)
            at, far = occurrences(ids, starts, size)
            new = ~_within(known, at, at + far + size)
            known = np.concatenate([known, _extended(stretches, at[new], far[new], shortest, power)])
        size *= 2
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def _extended(stretches: _Stretches, at: np.ndarray, far: np.ndarray, shortest: int, power: int) -> np.ndarray:
    first, end = stretches.around(at, far)
    good = end - first >= np.maximum(shortest, power * far)
    found = np.stack([first, end, far], axis=1)[good]
    if not len(found):
        return found
    whole, group = np.unique(found, axis=0, return_inverse=True)
    ids, out = stretches.ids, set()
    for k, (a, b, d) in enumerate(whole.tolist()):
        if np.array_equal(ids[a : b - d], ids[a + d : b]):
            out.add((a, b, d))
            continue
        # Hashes of different stretches met: look at each place word by word.
        for s in at[good][group.reshape(-1) == k].tolist():
            a, b = stretches.exactly_around(s, d)
            if b - a >= max(shortest, power * d):
                out.add((a, b, d))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


# --- texts -----------------------------------------------------------------------

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each has. Only the six ASCII
    white-space characters separate them."""
    trimmed = pc.ascii_trim_whitespace(texts.cast(pa.string()))
    lists = pc.ascii_split_whitespace(trimmed)
    empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    if empty.any():  # an empty text is split into one empty word
        words = words.filter(pa.array(np.repeat(~empty, counts)))
        counts[empty] = 0
    return words, counts


def _searched(names: list[str], shortest: int, power: int):
    def some(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words, counts = _split(texts)
        codes = words.dictionary_encode()
        plain = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]  # of each text, in the joined sequence
        joined = np.empty(len(plain) + len(counts), np.int64)
        ends = first + counts
        inside = np.ones(len(joined), bool)
        inside[ends] = False
        joined[inside] = plain
        joined[ends] = len(codes.dictionary) + np.arange(len(counts))
        runs = runs_of(joined, int(counts.max(initial=0)), shortest, power)
        owner = np.searchsorted(first, runs[:, 0], "right") - 1
        step = np.zeros(len(joined) + 1, np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 1], -1)
        stays = (np.cumsum(step)[:-1] == 0)[inside]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(counts)), counts)[stays], minlength=len(counts)))])
        left = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.filter(pa.array(stays)))
        table = pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in (runs[:, 0] - first[owner], runs[:, 1] - runs[:, 0], runs[:, 2])], fields=list(_RUN)
        )
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))])
        return pa.RecordBatch.from_arrays(
            [ids, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), table), pc.binary_join(left, " ")],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Every second byte at most begins a word.
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // 2 + 1)
            start = 0
            while start < batch.num_rows:
                done = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, done + _TOGETHER, "right")))
                yield some(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start))
                start = end

    return run


def word_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, power: int = POWER
) -> DataFrame:
    """`doc_id, runs, collapsed`, one row per row of `docs`.

    A run is a stretch of consecutive words with smallest period q, at least
    `shortest` words and `power` periods long (3 at least), that no neighbouring
    word extends. `runs` lists `start, length, period` of each by start, then
    period, with words numbered from 0. `collapsed` holds the words that stay,
    joined by one space: those that no run contains after its first q words.

    A null, empty or blank text has no runs and an empty `collapsed`. Ids play
    no part, so null and repeated ids and repeated rows each get their own row;
    an empty table gives none; other columns of `docs` are ignored.
    """
    slim = docs.select(q(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return slim.mapInArrow(_searched(["doc_id", "runs", "collapsed"], shortest, power), fields)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared in whole numbers; the
    first of equals, null for no run."""
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    return F.aggregate(
        runs,
        F.lit(None).cast(kind),
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )
