"""Exact duplicates, with the frequent texts split off.

One reading of the texts leaves a slim table of digests. A Misra-Gries summary
of it names every digest that could hold a large share of the rows; these few
are counted exactly and their winners broadcast, so rows with a frequent text
are settled where they lie. All other rows take an ordinary exchange: groups are
counted on their way to it, and meet their winner in a join.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.llm.common import SPACE, q, text_of, unused

COUNTERS = 1023


def normalised(text_col: str):
    return F.regexp_replace(text_of(text_col), f"{SPACE}+", " ")


def misra_gries(counters: int):
    """Per task: at most `counters` (digest, estimate) pairs.

    Batches are added whole and the summary cut back by its (counters + 1)-th
    largest estimate, so an estimate is never too high and falls short by at
    most rows / (counters + 1), over all tasks together as well.
    """

    def run(batches):
        kept: dict[bytes, int] = {}
        for batch in batches:
            for digest, n in Counter(batch["digest"]).items():
                kept[digest] = kept.get(digest, 0) + n
            if len(kept) > counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = {d: n - cut for d, n in kept.items() if n > cut}
        yield pd.DataFrame({"digest": list(kept), "estimate": list(kept.values())})

    return run


def frequent_digests(slim: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters + 1` digests, among them all with over 2 / (counters + 1) of the rows.

    Estimates add up to the number of rows at most, so no more than
    `counters + 1` digests can reach the bound below: that makes the result
    safe to broadcast whatever the input.
    """
    partial = slim.select("digest").mapInPandas(misra_gries(counters), "digest binary, estimate long")
    summed = partial.groupBy("digest").agg(F.sum("estimate").alias("estimate"))
    return summed.filter(F.col("estimate") * (counters + 1) >= F.lit(slim.count())).select("digest")


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """`doc_id, keep_id, group_size, kept, text_sha256`, one row per row of `docs`.

    Texts are equal when they agree after every run of white space became one
    space; a null text is empty. Of equal texts the least id stays; a null id
    comes after all others, and of rows that repeat the winning id one stays
    (`keep_id` is null where every id of the group is). An empty table gives no
    rows; other columns of `docs` play no part.
    """
    slim = materialize(
        docs.select(
            q(id_col).alias("doc_id"),
            F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_no")
    frequent = materialize(frequent_digests(slim, counters), "frequent")
    winners = materialize(
        slim.join(F.broadcast(frequent), "digest")
        .groupBy("digest")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("group_size")),
        "winners",
    )
    rest = slim.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # Combined before the exchange; the join back is one that can be split.
    firsts = rest.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("group_size"))

    def settled(rows: DataFrame, groups: DataFrame) -> DataFrame:
        return rows.join(groups, "digest").select(
            "doc_id",
            F.col("first.doc_id").alias("keep_id"),
            "group_size",
            (F.col("row_no") == F.col("first.row_no")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    return settled(slim, F.broadcast(winners)).unionByName(settled(rest, firsts))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    A document is known by its id here: rows that repeat the id of a winner
    with an equal text stay together.
    """
    own, digest = unused(docs, "own_id", "digest")
    kept = duplicate_groups(docs, id_col, text_col).filter("kept").select("doc_id", "text_sha256").toDF(own, digest)
    same = q(id_col).eqNullSafe(q(own)) & (F.sha2(normalised(text_col), 256) == q(digest))
    return docs.join(kept, same, "left_semi")
