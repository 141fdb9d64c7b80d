"""A corpus from raw documents to tokens, in five stages.

    run(spark, folder)

Each stage is (name, function); a function takes the session, the documents
that the stage before kept, and the folder of the tables, and returns the
documents it keeps. `run` stores every stage's rows in the shared folder.

For every stage: a null text counts as empty, an empty table gives no rows, rows
that repeat are rows of their own, and further columns of the documents stay (in
the last stage, none do) whatever their names, but for `n_lines` and `n_dropped`,
which the second stage takes away.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from espalier.durable import materialize  # noqa: E402
from espalier.llm import bpe, line_dedup, mixing, quality, simhash  # noqa: E402
from espalier.llm.common import table  # noqa: E402
from espalier.llm.queries import BPE_FILE, token_digests  # noqa: E402
from espalier.session import share  # noqa: E402


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and the record of their source keep.

    A null source is one source, a null language one part of its source. Rows
    equal in id and text stay or go together. Without labels of both kinds all stay.
    """
    share(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds.

    Rows that share an id are one document; null ids are one document, the last.
    A text may end up empty; its document stays. `n_chars` is counted anew.
    """
    share(spark)
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the least id.

    Texts without a word are one group. Rows that share the id that stays all
    stay; rows with a null id stay only where their group has no other.
    """
    share(spark)
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document is there once per epoch.

    A document without words is in no epoch that a cut ends, so it may go; a null
    source is one source, the last.
    """
    share(spark)
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the text decoded from them, a row for each row."""
    share(spark)
    definition = bpe.read_definition(BPE_FILE)
    decoded = bpe.decode(bpe.encode(docs, definition), definition)
    return token_digests(decoded, "ids")


STAGES = [
    ("quality", good_documents),
    ("lines", fresh_lines),
    ("near-duplicates", one_of_each),
    ("mix", mixture),
    ("bpe", tokens),
]

# The fitted classifier, XXH64 and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    share(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
