"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores.

    A file with one row group is one task, however many cores wait. Such a scan is dealt out; a scan that already has a
    task per core, as any large input has, stays as it is. Filters and column pruning pass through to the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
