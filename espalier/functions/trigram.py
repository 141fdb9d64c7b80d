"""Trigram sets and their overlap, with built-in array functions only.

A title is lowercased and split into maximal runs of letters and digits; each
run gets two spaces before and one after; the set of all three-character
substrings of the padded runs is the title's trigram set (q-gram matching:
Gravano et al., VLDB 2001).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
WORD_CHARACTER = r"[\p{L}\p{N}]"


def trigrams(col: Column) -> Column:
    """The set as an array without repeats, in no promised order."""
    runs = F.array_remove(F.array_distinct(F.split(F.lower(col), NOT_WORD)), "")
    padded = F.transform(runs, lambda run: F.concat(F.lit("  "), run, F.lit(" ")))
    windows = F.transform(
        padded,
        lambda run: F.transform(
            F.sequence(F.lit(1), F.length(run) - 2),
            lambda start: run.substr(start, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(windows))


def codes(tokens: Column) -> Column:
    """The same set with each trigram as one whole number: three code points of
    21 bits. Numbers sort and intersect several times faster than strings."""

    def code(token: Column) -> Column:
        first, second, third = (F.ascii(token.substr(F.lit(i), F.lit(1))).cast("long") for i in (1, 2, 3))
        return F.shiftleft(first, 42).bitwiseOR(F.shiftleft(second, 21)).bitwiseOR(third)

    return F.transform(tokens, code)


def shared(left: Column, right: Column) -> Column:
    """Size of the intersection of two trigram sets."""
    return F.size(F.array_intersect(left, right))


def combined(left: Column, right: Column, common: Column) -> Column:
    """Size of the union, from the sizes and the intersection's size."""
    return F.size(left) + F.size(right) - common


def ratio(common: Column, union: Column) -> Column:
    """Similarity from its two counts; two empty sets have similarity 0."""
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def similarity(left: Column, right: Column) -> Column:
    a, b = trigrams(left), trigrams(right)
    common = shared(a, b)
    return ratio(common, combined(a, b, common))


@dataclass(frozen=True)
class Threshold:
    """A similarity bound kept as a fraction, so no test meets a float edge."""

    over: int = 3
    under: int = 10

    def __post_init__(self) -> None:
        if not 0 < self.over <= self.under:
            raise ValueError("a threshold lies in (0, 1]")

    def reached(self, common: Column, union: Column) -> Column:
        """Two empty sets never match."""
        return (common > 0) & (common * self.under >= union * self.over)

    def share_of(self, size: Column) -> Column:
        """ceil(threshold * size), in whole numbers."""
        return ((size * self.over + (self.under - 1)) / self.under).cast("int")
