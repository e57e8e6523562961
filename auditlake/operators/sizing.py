"""Checks of size: when to broadcast, when to spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_KEYS = 1_000_000


def broadcast_keys(keys: DataFrame, limit: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Hint a broadcast if the key list is counted to be small; else leave the join to Spark.

    Counting stops at the limit. Use for narrow key columns only.
    """
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def spread(df: DataFrame) -> DataFrame:
    """Spread the input of a CPU-bound step if it has fewer splits than the session has cores.

    One small file is one split and would keep all other cores idle; a large table has far more
    splits than cores and is left as it is. For plans without a shuffle (scans and projections).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
