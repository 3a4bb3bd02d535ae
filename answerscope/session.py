"""Session helpers: a local builder for tests and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "answerscope", cores: str | None = None) -> SparkSession:
    """A ``local[n]`` session with the settings the library relies on (UTC, AQE)."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ANSWERSCOPE_DRIVER_MEMORY", "6g"))
        # plan building without a Python call-site round trip per column operation
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may leave it out; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return tempfile.mkdtemp(prefix="answerscope-")
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one intermediate table."""
    return f"{shared_folder(spark)}/answerscope-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows as a written table in the shared folder, which survives lost executors."""
    folder = scratch_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
