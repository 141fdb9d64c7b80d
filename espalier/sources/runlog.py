"""A table kept as runs of changes, with a log that says which runs count.

A batch counts from the moment that its line is in the log, one file. The newest
line names all runs that count, so readers never see half a batch, and merging
runs is one more line. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINE = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("batch", T.StringType()),
        T.StructField("runs", T.ArrayType(T.StringType())),
    ]
)


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _lines(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LINE).json(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LINE)

    def has(self, batch: str) -> bool:
        return self._lines().filter(F.col("batch") == batch).limit(1).count() > 0

    def newest(self) -> tuple[int, list[str]]:
        """The last number and the runs that count."""
        last = self._lines().agg(F.max_by(F.struct("*"), "number").alias("last")).first()["last"]
        return (0, []) if last is None else (last["number"], last["runs"])

    def fresh(self, number: int) -> str:
        """A path for a run that no other attempt uses."""
        return f"{self.path}/runs/{number}-{uuid.uuid4().hex}"

    def commit(self, number: int, batch: str, runs: Sequence[str]) -> None:
        line = self.spark.createDataFrame([(number, batch, list(runs))], _LINE)
        line.coalesce(1).write.mode("append").json(f"{self.path}/log")
