"""Use all cores on inputs that arrive in few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores when it has fewer partitions than there are cores.

    For CPU-heavy work on one large JSON document or a file of few row groups. An input with enough splits, as any
    large one has, is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
