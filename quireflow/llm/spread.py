"""Work in Python workers, spread over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """df in at least `per_core` partitions a core, for stages whose cost is CPU time in Python and not reading.

    An input that already has as many (any large one) passes by without a shuffle; a small one in few files is moved once.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
