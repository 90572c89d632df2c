"""Parquet tables with enough partitions to keep every core busy, and size checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a directory.

    A table of several splits is left alone.  A table of one split, which is at most
    ``spark.sql.files.maxPartitionBytes`` large, would run as one task, so it is dealt over the cores.
    """
    return spread(spark.read.parquet(f"{root}/{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() == 1 else scan


def measured_bytes(df: DataFrame, size: Column) -> tuple[int, int]:
    """Row count and summed ``size`` of a small side, in one aggregate."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])
