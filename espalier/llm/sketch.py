"""Threshold-scaled fingerprints, with built-in functions only.

A fingerprint keeps every hash of a shingle that lies below a fixed fraction of
the hash range, and no other. Fingerprints of any two texts are therefore samples
of the same hashes: their union is the sample of both, and shares of common hashes
estimate resemblance and containment however unequal the texts. A short text may
keep no hash at all: its sketch says nothing, and nothing is put in its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.llm.common import WORD, q, text_of
from espalier.operators.keys import assign_keys, last_key

SHINGLE = 5
# One hash in so many is kept: those below -2**63 + 2**64 / SCALE.
SCALE = 4


def sketch(text: Column, scale: int = SCALE, shingle: int = SHINGLE) -> Column:
    """The kept hashes in ascending order.

    A text of fewer words is one shingle. A text without words has no hash, nor has
    one all of whose hashes lie above the bound.
    """
    last = F.lit(-(1 << 63) + (1 << 64) // scale - 1)

    def shingles(words: Column) -> Column:
        whole = F.transform(
            F.sequence(F.lit(0), F.size(words) - shingle),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)]),
        )
        short = F.array(F.aggregate(words, F.lit(shingle).cast("long"), lambda h, w: F.xxhash64(h, w)))
        return F.when(F.size(words) >= shingle, whole).when(F.size(words) > 0, short).otherwise(F.array().cast("array<long>"))

    def kept(hashes: Column) -> Column:
        return F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h <= last)))

    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    # Each step is bound to a lambda's variable, so it is evaluated once.
    return _bind(_bind(words, shingles), kept)


def _bind(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the shingles of two texts together."""
    return F.sort_array(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both, 0 to 1; 0 for two empty sketches, which show nothing in common."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(0.0)).otherwise(common / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of `a`'s shingles that `b` holds, 0 to 1; 1 for an empty `a`, which misses none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def written(hashes: Column) -> Column:
    """The hashes as hexadecimal digits, 16 each."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), "")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, one row per row of `docs`.

    The edited text ends, in place of its last quarter of code points, with as
    many first code points of the next document by ascending id (all of them if
    it has fewer); the first document follows the last. A null text is empty, a
    null id comes last. Rows equal in id and text are one document in this
    order; rows that share only the id are ordered by a hash of their texts. A
    lone document is its own next. Equal texts have likeness 1 and hold each
    other whatever their sketches keep; `n_kept` and `n_kept_edited` tell how many
    hashes an estimate rests on. An empty table gives no rows.

    A text's own sketch is made once, before it moves: it goes with the text to
    its place in the order, and with the first part of the text, in place of the
    whole, on to the document before.
    """
    key = [
        q(id_col).isNull().alias("late"),
        F.coalesce(q(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text_of(text_col)).alias("mark"),
    ]
    names = ["late", "id", "mark"]
    texts = docs.select(*key, text_of(text_col).alias("text"))
    sizes = texts.select(*names, F.length("text").cast("long").alias("n")).groupBy(*names).agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")
    )
    ranked = materialize(assign_keys(sizes, names, key="rank"), "sketch-order")
    last = last_key(ranked, "rank")
    before = ranked.select(
        F.when(F.col("rank") == last, F.lit(1)).otherwise(F.col("rank") + 1).alias("rank"),
        F.struct(*names, F.expr("n div 4").alias("part")).alias("to"),
    )
    places = materialize(ranked.join(before, "rank").drop("rank", "n"), "sketch-places")
    sketched = texts.select("*", sketch(F.col("text")).alias("sketch")).repartition(*names)
    placed = sketched.join(places, names)
    given = placed.select(
        *[F.col(f"to.{c}").alias(c) for c in names],
        F.col("copies"),
        F.left("text", F.col("to.part").cast("int")).alias("head"),
        F.struct("mark", F.length("text").alias("n"), "sketch").alias("next"),
    )
    # Copies of one row would each give the same; only those need the grouping.
    once = given.filter("copies = 1").unionByName(given.filter("copies > 1").dropDuplicates(names)).drop("copies")
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 4).cast("int")), F.col("head"))
    both = placed.join(once, names).select(
        F.when(~F.col("late"), F.col("id")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        "sketch",
        sketch(edited).alias("edited_sketch"),
        F.col("next.sketch").alias("next_sketch"),
        (edited == F.col("text")).alias("same"),
        ((F.col("next.mark") == F.col("mark")) & (F.col("next.n") == n)).alias("same_next"),
    )
    own, other, following = (F.col(c) for c in ("sketch", "edited_sketch", "next_sketch"))

    def unless_same(same: str, estimate: Column) -> Column:
        return F.when(F.col(same), F.lit(1.0)).otherwise(estimate)

    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(own).alias("fingerprint"),
        written(other).alias("edited_fingerprint"),
        unless_same("same", likeness(own, other)).alias("near_edited"),
        unless_same("same_next", likeness(own, following)).alias("near_next"),
        unless_same("same", containment(own, other)).alias("held_by_edited"),
        F.size(own).alias("n_kept"),
        F.size(other).alias("n_kept_edited"),
    )
