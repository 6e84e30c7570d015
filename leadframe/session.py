"""The session that the command-line tools and tests use; a cluster brings its own."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("leadframe").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.maxBytesPerBatch", "67108864")  # documents may be large
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which driver and executors share. Where it is unset, one on
    this machine if Spark runs in this process alone; on a cluster that would lose data silently, so it is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="leadframe-")


def durable(df: DataFrame) -> DataFrame:
    """What has been computed, cut off from how: a checkpoint in the shared folder, which outlives the loss of any executor."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
