"""The driver's tables as the library's inputs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table's rows for work that is long beside the reading: a file of few row groups is read by few tasks, so its rows are dealt out to all cores; larger tables are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dealt(rows: DataFrame, key: str, most: int) -> DataFrame:
    """A table's rows dealt by a key, about ``most`` to a task: what is made of each row by column expressions is dealt by it too, so windows and groups by the key need no shuffle of their own."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / most)), key)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer, each valid until the next one."""
    following = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("authority_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").cast("date").alias("effective_date"), following.cast("date").alias("end_date_exclusive")
    )
