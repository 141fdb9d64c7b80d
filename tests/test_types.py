from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from espalier.functions.types import fits_numeric, fits_type, fits_varchar, to_numeric, to_type, to_varchar
from espalier.plans.catalog import IMPORTANCE


def _texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def test_varchar_trims_only_excess_spaces(spark):
    df = _texts(spark, "abc", "abcd", "abcd   ", "ab  ", None)
    got = [r[0] for r in df.select(to_varchar(F.col("s"), 4)).collect()]
    assert got == ["abc", "abcd", "abcd", "ab  ", None]


def test_varchar_too_long_stops_the_job(spark):
    with pytest.raises(PySparkException, match="too long for 4"):
        _texts(spark, "abcde").select(to_varchar(F.col("s"), 4)).collect()


def test_fits_varchar_at_the_edge(spark):
    df = _texts(spark, "abc", "abcd", "abcde", "abcd ", None)
    assert [r[0] for r in df.select(fits_varchar(F.col("s"), 4)).collect()] == [True, True, False, True, None]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_numeric_rounds_half_up_then_judges(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(Decimal(v) if v else None,) for v in
                                    ("1.25", "99.94", "99.95", "100", "-99.95", "-99.94", None)], "x decimal(10,3)")
        assert [r[0] for r in df.select(fits_numeric(F.col("x"), 3, 1)).collect()] == [
            True, True, False, False, False, True, True]
        ok = df.filter(fits_numeric(F.col("x"), 3, 1)).select(to_numeric(F.col("x"), 3, 1).alias("y"))
        assert [r[0] for r in ok.collect()] == [Decimal("1.3"), Decimal("99.9"), Decimal("-99.9"), None]
        with pytest.raises(PySparkException, match="not a decimal"):
            df.select(to_numeric(F.col("x"), 3, 1)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_numeric_of_doubles_and_text(spark):
    df = spark.createDataFrame([(1e40, "x"), (float("nan"), "9.9"), (99.9, None), (None, "1e9")], "d double, s string")
    assert [r[0] for r in df.select(fits_numeric(F.col("d"), 3, 1)).collect()] == [False, False, True, True]
    assert [r[0] for r in df.select(fits_numeric(F.col("s"), 3, 1)).collect()] == [False, True, True, False]


def test_to_type_of_text(spark):
    df = _texts(spark, "12", None)
    assert [r[0] for r in df.select(to_type(F.col("s"), T.IntegerType())).collect()] == [12, None]
    assert [r[0] for r in _texts(spark, "a", "3").select(fits_type(F.col("s"), T.IntegerType())).collect()] == [False, True]
    with pytest.raises(PySparkException, match="not a int"):
        _texts(spark, "a").select(to_type(F.col("s"), T.IntegerType())).collect()


def test_domain_order_is_not_alphabetical(spark):
    df = _texts(spark, "LOW", "MEDIUM", "HIGH", "CRITICAL", "OTHER", None)
    ranked = df.select("s", IMPORTANCE.rank(F.col("s")).alias("r")).orderBy(F.col("r").asc_nulls_last(), "s")
    assert [tuple(r) for r in ranked.collect()] == [
        ("CRITICAL", 1), ("HIGH", 2), ("MEDIUM", 3), ("LOW", 4), (None, None), ("OTHER", None)]


def test_fractions_round_into_integers(spark):
    from espalier.sources.ingest import conform
    from espalier.spec import Column, TableSpec

    spec = TableSpec("t", (Column("v", T.IntegerType()),))
    loaded = conform(spark.createDataFrame([(1.7,), (2.5,), (-0.5,), (None,)], "v double"), spec)
    assert [r.v for r in loaded.collect()] == [2, 3, -1, None]
    with pytest.raises(PySparkException, match="not a int"):
        conform(spark.createDataFrame([(2147483647.5,)], "v double"), spec).collect()
