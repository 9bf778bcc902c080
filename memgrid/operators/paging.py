"""Cursors over snapshots: pages of a sorted table, each read from the ranges that hold it."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import shared_folder


@dataclass(frozen=True)
class Page:
    """The rows of a page, the cursor for the next one (none after the last), and how many rows the snapshot has."""

    rows: list[Row]
    cursor: str | None
    full_count: int

    @property
    def has_more(self) -> bool:
        return self.cursor is not None


def snapshot(rows: DataFrame, keys: Sequence[str], batch: int = 1000, per_range: int = 100_000, folder: str | None = None) -> str:
    """Writes rows in the order of `keys` (ascending, null first) and gives the cursor of the first page.

    Ranges of the keys become folders, and an index has a row for each: its last keys, and how many rows come before and in it. The
    snapshot doesn't change, so cursors hold whatever happens to the table. Rows with equal keys are told apart by their place in the range.
    """
    spark = rows.sparkSession
    folder = folder or f"{shared_folder(spark)}/memgrid-snapshot-{uuid.uuid4().hex}"
    n = rows.count()
    order = [F.col(c).asc_nulls_first() for c in keys]
    ranges = max(1, -(-n // per_range))
    dealt = rows.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "_spread").sortWithinPartitions(*order, "_spread")
    placed = dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    out = placed.drop("_spread").write
    (out.partitionBy("_range") if n else out).parquet(f"{folder}/rows")  # an empty table has no folders that could tell its columns
    own = spark.read.parquet(f"{folder}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    own.select("_range", "n", before.alias("before")).coalesce(1).write.parquet(f"{folder}/index")
    return _cursor(folder, batch, 0, n)


def _cursor(folder: str, batch: int, at: int, n: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([folder, batch, at, n]).encode()).decode()


def _within(index: list[Row], at: int, batch: int) -> Column:
    """The rows from `at` on, a batch of them, by range and place in it."""
    out = F.lit(False)
    for r in index:
        low, high = max(at - r["before"], 0), at + batch - r["before"]
        out = out | ((F.col("_range") == r["_range"]) & (F.col("_at") >= low) & (F.col("_at") < high))
    return out


def frame(spark: SparkSession, cursor: str) -> DataFrame:
    """The page of a cursor as a frame, with its order in _range and _at: only the ranges that hold it are read, and of these by their places."""
    folder, batch, at, _ = json.loads(base64.urlsafe_b64decode(cursor))
    index = spark.read.parquet(f"{folder}/index").where((F.col("before") < at + batch) & (F.col("before") + F.col("n") > at)).collect()  # the page's ranges
    return spark.read.parquet(f"{folder}/rows").where(F.col("_range").isin([r["_range"] for r in index])).where(_within(index, at, batch))


def following(cursor: str) -> str | None:
    """The cursor of the next page; none after the last."""
    folder, batch, at, n = json.loads(base64.urlsafe_b64decode(cursor))
    return _cursor(folder, batch, at + batch, n) if at + batch < n else None


def page(spark: SparkSession, cursor: str) -> Page:
    """The page of a cursor, `batch` rows at most. The same cursor always gives the same page."""
    rows = frame(spark, cursor).orderBy("_range", "_at").drop("_range", "_at").collect()
    return Page(rows, following(cursor), json.loads(base64.urlsafe_b64decode(cursor))[3])
