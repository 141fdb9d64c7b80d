"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(
    app: str = "espalier", cores: str | int = "*", partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording a call site for every column operation slows plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return pin(spark)


def pin(spark: SparkSession) -> SparkSession:
    """Instants are read, cast and printed in UTC, whatever the host's zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def share(spark: SparkSession) -> SparkSession:
    """For programs that may run on one machine: see that a shared folder is set.

    A session that names one keeps it. Without one, a local session gets a
    folder of its own; a cluster has to name one.
    """
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="espalier-"))
    return spark
