"""A session with the settings that the library's operators expect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "docloom", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; further settings as given (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, by ``spark.checkpoint.dir``; one of our own only on a local master (tests), where none is set."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or "spark-warehouse/checkpoints"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
