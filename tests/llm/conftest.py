from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
COLUMNS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def awkward(seed: int = 3) -> list[tuple]:
    """Documents with nulls, empty and very long texts, copies, ties and shared lines."""
    dice = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "été", "don't", "42", "中文", "x", "naïve", "😀", "END."]

    def line(n: int) -> str:
        return " ".join(dice.choice(words) for _ in range(n))

    shared = "  The Shared line of many\t"
    rows = [
        (0, None, "en", "a", None),
        (1, "", "en", "a", 0),
        (2, " \t\n ", None, "b", 4),
        (3, shared + "\nown text of three", "en", "a", 40),
        (4, "the shared LINE of many\n\nthe shared line of many\nshort\nshort", "en", None, 60),
        (5, "short\nshort", "de", "", 11),
        (6, line(20_000), "en", "long", 0),
        (7, "word " * 30_000, "en", "long", 0),
        (8, "a\x0b\x0cb\r\nc\x1cd\x85e\xa0f", "fr", "b", 12),
        (9, "ab<|endoftext|>cd  <|endoftext|>   \n\n 'll we've", "fr", "b", 30),
        (10, "!" * 9000 + " 　 x", "fr", "b", 30),
        (None, "no id at all but some words here to count", "en", "b", 30),
        (None, "no id either, the shared line of many", "en", "b", 30),
    ]
    text = line(60)
    rows += [(20 + i, text, "en", "hot", 300) for i in range(8)]  # copies
    rows += [(40 + i, text + " " + line(1), "en", "hot", 300) for i in range(8)]  # near copies
    rows += [(20, text, "en", "hot", 300), (3, shared + "\nown text of three", "en", "a", 40)]  # repeated rows
    rows += [(60 + i, "\n".join(line(dice.randint(0, 30)) for _ in range(dice.randint(1, 6))), "en", f"s{i % 4}", 9) for i in range(40)]
    dice.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns that are named like results and helpers."""
    from pyspark.sql import functions as F

    names = (
        "n_lines kept key_id key_text line size words bin print target range place rank id mark late n copies p sum "
        "host path of good keep ids fills score lang_pred tokens tokenizer html own_id own_text own_source often_id "
        "often_text often_source epochs epoch good_id good_text drop_id drop_text drops new digest digest_ __id __text "
        "__drop_id __drop_text __drops __new __often_id __epochs __epoch __good_id __good_text __digest __source"
    ).split()
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


def of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
