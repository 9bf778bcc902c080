"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session on one machine gets its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="memgrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df written and read back: what is used again is made once, lineage ends, and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/memgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as saved() keeps it, dealt out by key into as many buckets as the session has shuffle partitions: a join on key doesn't move its rows again."""
    spark = df.sparkSession
    name = f"memgrid_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("compression", "zstd")
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has fewer parts, as that of a small table in one file has; large tables stay as they are and move nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def version(spark: SparkSession, path: str) -> str:
    """What changes when a table's files do: their number, their bytes, and when the path was last changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    all_of = fs.getContentSummary(at)
    return f"{all_of.getFileCount()}-{all_of.getLength()}-{fs.getFileStatus(at).getModificationTime()}"


_STORED: dict[tuple[str, ...], str] = {}


def stored_at(spark: SparkSession, name: str, source: str, make: Callable[[str], object]) -> str:
    """A folder that is made of the table at `source` once a session, and again when its files change, as an index is. make: writes into the folder."""
    key = (spark.sparkContext.applicationId, name, source, version(spark, source))
    if key not in _STORED:
        folder = f"{shared_folder(spark)}/memgrid-{name}-{uuid.uuid4().hex}"
        make(folder)
        _STORED[key] = folder
    return _STORED[key]


def stored(df: Callable[[], DataFrame], spark: SparkSession, name: str, source: str) -> DataFrame:
    """A table that is derived from the one at `source`, kept as stored_at() says; df makes it."""
    return spark.read.parquet(stored_at(spark, name, source, lambda folder: df().write.parquet(folder)))
