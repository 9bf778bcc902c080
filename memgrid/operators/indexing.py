"""Dense row numbers without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import saved


def dense_index(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """rows with their place, from 0, in the order of a unique key. Ranges of the key are numbered apart as they are written, so rows move
    once; the broadcast has a row for each range."""
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key)
    # the second number counts a part's rows in their order
    ranged = saved(ranged.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return placed.withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_before")
