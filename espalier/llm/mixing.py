"""Mixing sources to target weights, with built-in functions only.

Documents get a hash-random place within their source. Ranges of (source,
place) are spread over the tasks, so a hot source takes many; running totals
of words are exact: within a range by a window, across ranges by the totals of
the ranges before. A source is then cut where its budget ends, after as many
whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.llm.common import WORD, q, row_key, shuffle_partitions, text_of, unused
from espalier.operators.keys import assign_keys

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def n_words(text_col: str):
    """Runs of characters other than white space."""
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """`sources (source, source_size)` with `target` words for each.

    Sources take the weights in the order of their code points, null last, and
    share the sum of all sizes. A share above `most` times its source's size
    stops there, and what is over is shared out again by weight. Each round
    brings two sums to the driver and stops at least one more source; all
    comparisons are between whole numbers.
    """
    ranked = assign_keys(sources, "source", key="rank")
    parts = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = materialize(
        ranked.select("source", "source_size", parts.cast("decimal(38,0)").alias("weight")), "mix-sources"
    )
    most_words = (F.col("source_size") * most).cast("decimal(38,0)")
    total = int(ranked.agg(F.sum("source_size")).first()[0] or 0)
    # The water level left / among: a source stops if its most lies below its share.
    left, among = total, None
    while True:
        stopped = F.lit(False) if among is None else F.col("weight") * left >= most_words * among
        row = ranked.agg(
            F.sum(F.when(~stopped, F.col("weight"))).alias("among"),
            F.coalesce(F.sum(F.when(stopped, most_words)), F.lit(0)).alias("given"),
        ).first()
        now = (total - int(row["given"]), int(row["among"] or 0))
        if now == (left, among) or not now[1]:
            break
        left, among = now
    share = (F.col("weight") * left).cast("double") / F.lit(among or 1).cast("double")
    stopped = F.col("weight") * left >= most_words * (among or 1)
    return ranked.select(
        "source", "source_size", F.when(stopped, most_words.cast("double")).otherwise(share).alias("target")
    )


def running_words(slim: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """`slim` with `before`, the words of its source in places before this one,
    and the columns of `sources (name, …)`."""
    spark = slim.sparkSession
    placed = slim.withColumn("place", F.xxhash64("key_id", "key_text", F.lit(seed)))
    order = [F.col("source").asc_nulls_first(), F.col("place"), F.col("key_id"), F.col("key_text"), F.col("row_no")]
    ranged = materialize(
        placed.repartitionByRange(shuffle_partitions(spark), *order).withColumn("range", F.spark_partition_id()),
        "mix-ranges",
    )
    # One row for each range and source in it; the rows of one source are as
    # many as the ranges that it spans.
    totals = ranged.groupBy("range", "source").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("range").alias("at"), F.col("source").alias("of"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")
    ).join(sources, F.col("of").eqNullSafe(F.col("name")))
    within = Window.partitionBy("range", "source").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    match = (F.col("range") == F.col("at")) & F.col("source").eqNullSafe(F.col("of"))
    return summed.join(starts, match).withColumn("before", F.col("start") + F.col("inside"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 7,
) -> DataFrame:
    """One row per row of `docs`: `doc_id, source, size, source_size, target, taken, epochs`.

    `taken` words add up to the whole part of the target for each source: as
    many whole epochs as it holds, then the words up to the cut. `epochs` is the
    number of epochs that the document begins in (a document at the cut begins
    in one more than it completes). A document without words takes none. Null
    sources are one source. The same rows give the same mix.
    """
    slim = materialize(
        docs.select(
            q(id_col).alias("doc_id"),
            *row_key(id_col, text_col),
            q(source_col).cast("string").alias("source"),
            n_words(text_col).alias("size"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "mix-sizes",
    )
    sources = materialize(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    budget = targets(sources, weights).withColumnRenamed("source", "name")
    placed = running_words(slim, budget, seed)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    counted = placed.withColumn("whole", whole.cast("long")).withColumn(
        "rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size")
    )
    part = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("size"))
    return counted.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + part).alias("taken"),
        (F.col("whole") + (F.col("before") < F.col("rest")).cast("long")).alias("epochs"),
        "key_id",
        "key_text",
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as an epoch begins it.

    Documents stay whole, so a source may run over its budget by part of one
    document; `mix` has the exact words.
    """
    chosen = mix(docs, id_col, text_col, source_col, **how)
    often = chosen.groupBy("key_id", "key_text", "source").agg(F.max("epochs").alias("epochs")).filter("epochs > 0")
    key = [*row_key(id_col, text_col), q(source_col).cast("string")]
    names = unused(docs, "own_id", "own_text", "own_source", "often_id", "often_text", "often_source", "epochs", "epoch")
    own, of, epochs, epoch = names[:3], names[3:6], names[6], names[7]
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(key, own)])
    match = [q(a).eqNullSafe(q(b)) for a, b in zip(own, of)]
    repeated = keyed.join(often.toDF(*of, epochs), match).withColumn(epoch, F.explode(F.sequence(F.lit(1), q(epochs))))
    return repeated.select(*[q(c) for c in docs.columns])
