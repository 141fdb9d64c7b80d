"""Cutting lineage through a shared folder.

A multi-pass job must see the same rows in every pass even when executors are
lost in between. Its intermediate tables are therefore written to the folder
the cluster shares (`spark.checkpoint.dir`) and read back. Nothing here deletes
them: they belong to the folder's own retention rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/espalier/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and return the stored copy."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
