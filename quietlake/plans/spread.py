"""Enough partitions for all cores, where an input's own are fewer."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """``scan``, which must be a plain read of files, dealt to all cores if it has fewer partitions than there are cores.

    A small file is one partition, and whatever costs time a row would run on one core. Inputs of
    any size that matters have more partitions than cores and aren't shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan
