"""Stored tables with a unique key: writes by policy that touch only the parts that they change, and streams into them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stage import saved

POLICIES = ("ignore", "update", "replace", "error")
#: Bits of a Bloom filter for each key, the least number of bits, and bits that a key sets.
BITS_EACH, LEAST_BITS, HASHES = 10, 1 << 10, 5


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def bucket(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class DuplicateKey(ValueError):
    """A write with the policy `error` met keys that are there already, or one key twice."""


@dataclass(frozen=True)
class Written:
    """Rows of a write by what became of them."""

    created: int
    updated: int
    ignored: int


@dataclass(frozen=True)
class Keyed:
    """A table of files in `folder`, dealt out to `buckets` folders by a hash of its key.

    A write reads and rewrites the buckets that its keys fall into and no others (dynamic partition overwrite), so its cost follows the
    buckets touched, and running it again changes nothing. The merged rows are complete before the first file is replaced. One writer at a
    time. Rows without a key are refused.
    """

    spark: SparkSession
    folder: str
    key: str
    schema: StructType
    buckets: int = 64

    def stored(self) -> DataFrame:
        """The rows with their bucket."""
        schema = StructType([*self.schema.fields]).add("bucket", "integer")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/rows") if exists(self.spark, f"{self.folder}/rows") else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self.stored().select(*self.schema.names)

    def get(self, *keys: object) -> DataFrame:
        """The rows of these keys; only their buckets are read."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        wanted = [tuple(r) for r in wanted.select(self.key, bucket(self.key, self.buckets)).collect()]  # as many as were asked for
        return self.stored().where(F.col("bucket").isin([b for _, b in wanted]) & F.col(self.key).isin([k for k, _ in wanted])).select(*self.schema.names)

    def write(self, incoming: DataFrame, policy: str = "ignore", order: Sequence[str] = ()) -> Written:
        """Merges rows into the table.

        Of rows with a new key the first in `order` is created. With a key that is there, `ignore` keeps what is stored, `replace` takes
        the last row, `update` puts each column's last value that isn't null over the stored one; `error` refuses the whole write.
        Without an order, rows with equal keys stand in the order of all their columns.
        """
        if policy not in POLICIES:
            raise ValueError(policy)
        names = [c for c in self.schema.names]
        place = F.struct(*(order or names))
        new = saved(incoming.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), place.alias("_place")).withColumn("bucket", bucket(self.key, self.buckets)))
        if not new.where(F.col(self.key).isNull()).isEmpty():
            raise ValueError(f"rows without {self.key}")
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most `buckets` numbers
        if not touched:
            return Written(0, 0, 0)
        old = self.stored().where(F.col("bucket").isin(touched))
        by = W.partitionBy(self.key).orderBy("_place")
        whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        ranked = new.withColumn("_n", F.row_number().over(by)).withColumn("_of", F.count(F.lit(1)).over(whole))
        if policy == "update":
            ranked = ranked.select(*(F.last(c, ignorenulls=True).over(whole).alias(c) for c in names if c != self.key), self.key, "bucket", "_n", "_of")
        one = ranked.where("_n = _of" if policy in ("replace", "update") else "_n = 1")
        left = old.select(F.col(self.key).alias("_k"), F.struct(*names).alias("_old"))
        both = saved(one.select(F.col(self.key).alias("_k"), F.struct(*names).alias("_new"), "_of").join(left, "_k", "full"))
        n, seen, twice = both.agg(F.sum("_of"), F.count(F.when(F.col("_old").isNotNull(), F.col("_of"))), F.sum((F.col("_of") > 1).cast("int"))).first()
        if policy == "error" and (seen and not both.where("_old is not null and _new is not null").isEmpty() or twice):
            raise DuplicateKey(", ".join(str(r[0]) for r in both.where("_new is not null and (_old is not null or _of > 1)").select("_k").orderBy("_k").limit(5).collect()))
        created = both.where("_old is null").count()
        if policy == "ignore":
            pick = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c == self.key else F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
        elif policy == "update":
            pick = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}"))
        else:
            pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
        merged = both.select(*(pick(c).alias(c) for c in names)).withColumn("bucket", bucket(self.key, self.buckets))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/rows")
        changed = 0 if policy in ("ignore", "error") else int(n) - created
        return Written(created, changed, int(n) - created - changed)


def bits_of(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """HASHES places of each key in a filter of `size` bits, from two hashes of it."""
    with np.errstate(over="ignore"):
        steps = one.astype(np.uint64)[:, None] + two.astype(np.uint64)[:, None] * np.arange(HASHES, dtype=np.uint64)
    return (steps % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class Ingested:
    """A table that streams append to, each key once: rows, Bloom filters of their keys by bucket, and a fence for each batch.

    A batch's rows and filters lie in folders of its own, which a replay overwrites as a whole, and its fence comes last. Keys are held
    against all other batches, so one that was cut off before its fence gives the same rows again, and one with a fence does nothing.
    Filters answer first: a key that none of its bucket's filters knows is new without a look at the table; the others are joined with the
    stored keys of their buckets. One stream at a time; a stream without its checkpoint needs a new name.
    """

    spark: SparkSession
    folder: str
    key: str
    schema: StructType
    buckets: int = 64

    def _read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if exists(self.spark, f"{self.folder}/{name}") else self.spark.createDataFrame([], schema)

    def stored(self) -> DataFrame:
        """The rows with bucket and batch."""
        return self._read("rows", StructType([*self.schema.fields]).add("batch", "string").add("bucket", "integer"))

    def rows(self) -> DataFrame:
        return self.stored().select(*self.schema.names)

    def fenced(self, batch: str) -> bool:
        return exists(self.spark, f"{self.folder}/fences/{batch}/_SUCCESS")

    def fence(self, batch: str, rows: int) -> None:
        self.spark.createDataFrame([(batch, rows)], "batch string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/fences/{batch}")

    def maybe_known(self, keys: DataFrame, batch: str) -> DataFrame:
        """(key) of those that a filter of another batch knows, few of them wrongly. A group is a bucket: its filters, and the batch's keys in it."""
        filters = self._read("filters", FILTERS).where(F.col("batch") != batch)
        hashed = keys.select(self.key, "bucket", *_hashes(self.key))

        def f(own: pa.Table, held: pa.Table) -> pa.Table:
            one, two = (own.column(c).to_numpy() for c in ("h1", "h2"))
            known = np.zeros(len(one), bool)
            for bits in held.column("bits").to_pylist():
                table = np.frombuffer(bits, np.uint8)
                at = bits_of(one, two, len(table) * 8)
                known |= ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(1)
            return own.select([self_key]).filter(pa.array(known))

        self_key = self.key
        return hashed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(f, StructType([self.schema[self.key]]))

    def filters_of(self, keys: DataFrame) -> DataFrame:
        """(bucket, bits): a filter of BITS_EACH bits for each key of a bucket."""

        def f(own: pa.Table) -> pa.Table:
            size = max(LEAST_BITS, -(-own.num_rows * BITS_EACH // 8) * 8)
            bits = np.zeros(size, bool)
            bits[bits_of(own.column("h1").to_numpy(), own.column("h2").to_numpy(), size).ravel()] = True
            return pa.table({"bucket": pa.array([own.column("bucket")[0].as_py()], pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        return keys.select("bucket", *_hashes(self.key)).groupBy("bucket").applyInArrow(f, "bucket int, bits binary")

    def append(self, frame: DataFrame, number: int, stream: str = "stream") -> int:
        """Adds a stream's batch: of rows with a key that isn't there the first of each key. Gives how many it added."""
        batch = f"{stream}-{number}"
        if self.fenced(batch):
            return 0
        rows = frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).where(F.col(self.key).isNotNull())
        first = F.row_number().over(W.partitionBy(self.key).orderBy(*self.schema.names))
        rows = saved(rows.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("bucket", bucket(self.key, self.buckets)))
        maybe = saved(self.maybe_known(rows.select(self.key, "bucket"), batch).withColumn("bucket", bucket(self.key, self.buckets)))
        asked = [r[0] for r in maybe.select("bucket").distinct().collect()]  # at most `buckets` numbers
        there = self.stored().where(F.col("bucket").isin(asked) & (F.col("batch") != batch)).select(self.key)
        new = saved(rows.join(maybe.join(there, self.key, "left_semi").select(self.key), self.key, "left_anti").select(*self.schema.names, "bucket"))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/batch={batch}")
        self.filters_of(new).write.mode("overwrite").parquet(f"{self.folder}/filters/batch={batch}")
        added = new.count()
        self.fence(batch, added)
        return added

    def follow(self, frames: DataFrame, checkpoint: str, stream: str = "stream") -> None:
        """Appends what a streaming frame has now; a restart with the same checkpoint goes on there."""
        add = lambda frame, number: self.append(frame, number, stream) and None
        frames.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


FILTERS = StructType().add("bucket", "integer").add("bits", "binary").add("batch", "string")


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(F.col(key), F.lit(1)).alias("h1"), F.xxhash64(F.col(key), F.lit(2)).bitwiseOR(F.lit(1).cast("long")).alias("h2")]
