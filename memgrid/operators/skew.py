"""Joins with keys that many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import saved

#: A key with more than 1 / FREQUENT of all rows goes by broadcast; there are so many of them at most.
FREQUENT = 10_000
#: So few rows that all of them may share a key.
FEW = 1_000_000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The left join of rows with a table that has each key once. Frequent keys never gather in a task: their few rows of the table are broadcast."""
    rows = saved(rows)
    total = rows.count()
    if total <= FEW:
        return rows.join(table, key, "left")
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * FREQUENT > total).select(key, F.lit(True).alias("_often"))
    marked = rows.join(F.broadcast(often), key, "left")
    few = table.join(F.broadcast(often.drop("_often")), key, "left_semi")
    found = marked.where("_often").drop("_often").join(F.broadcast(few), key, "left")
    return found.unionByName(marked.where("_often is null").drop("_often").join(table, key, "left"))
