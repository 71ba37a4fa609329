"""Partitioning and broadcasting helpers of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Give a compute-heavy stage enough tasks where the scan has fewer than the cluster has cores.

    Large inputs arrive with many scan partitions and are left alone, without a shuffle.
    """
    cores = max(df.sparkSession.sparkContext.defaultParallelism, 2)
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *by)


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``, else for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df
