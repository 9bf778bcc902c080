"""What the text operators share: sizes, shared tables, byte buffers, hashes."""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that end a word.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that Python code works on at once, unless one text alone is longer.
SLICE_BYTES = 2 << 20
M64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a frame's input; no job runs. Where Spark can't tell (joins), 16 MB for each shuffle partition."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 50 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) << 24


def parts_for(df: DataFrame, bytes_each: int, least: int = 8, most: int = 1 << 16) -> int:
    return max(least, min(most, math.ceil(estimated_bytes(df) / bytes_each)))


def split_bytes(docs: DataFrame) -> int:
    """What an input split holds at most."""
    most = str(docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m")).lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(most[-1], 1)
    return max(1, min(int(most.rstrip("kmg")) * unit, estimated_bytes(docs)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine gets its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="memgrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that written() and bucketed() made in this process: folder, and catalog name if it has one.
_MADE: list[tuple[str, str | None]] = []


def cleared(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Removes the tables made from the `since`-th on, but those that `keep` reads. Frames that read the others can't be used any more."""
    used = "\n".join(keep.inputFiles())
    for path, name in _MADE[since:]:
        if path.split("/")[-1] in used:
            continue
        if name:
            spark.sql(f"drop table if exists {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _MADE[since:] = [x for x in _MADE[since:] if x[0].split("/")[-1] in used]


def made() -> int:
    """How many tables were made so far, for cleared()."""
    return len(_MADE)


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memgrid-{what}-{uuid.uuid4().hex}"
    _MADE.append((path, None))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, what: str) -> DataFrame:
    """As written(), as a table bucketed by key, so that groups and joins on key move none of its rows again."""
    spark = df.sparkSession
    name = f"memgrid_{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _MADE.append((path, name))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def blocks(docs: DataFrame, what: str, block_bytes: int = 6 << 20, extra: tuple[str, ...] = ()) -> DataFrame:
    """(block, row, doc_id, text, *extra) of all documents, nulls as empty texts, as a table bucketed by block.

    A block holds documents of one input split. Later stages deal with a block as one group and never shuffle texts.
    """
    size = estimated_bytes(docs)
    per = max(1, math.ceil(split_bytes(docs) / block_bytes))
    part = F.spark_partition_id().cast("long") * per
    text = F.coalesce("text", F.lit("")).alias("text")
    df = docs.select((part + F.pmod(F.xxhash64("doc_id"), F.lit(per))).alias("block"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text, *extra)
    return bucketed(df, "block", max(8, min(1 << 16, math.ceil(size / (block_bytes * 1.3)))), what)


def packed(docs: DataFrame, what: str, block_bytes: int = 4 << 20) -> DataFrame:
    """(block, row, doc) of all documents, doc a struct of their columns, as a table bucketed by block; blocks are as in blocks()."""
    per = max(1, math.ceil(split_bytes(docs) / block_bytes))
    row = F.monotonically_increasing_id()
    block = F.spark_partition_id().cast("long") * per + F.pmod(F.xxhash64(row), F.lit(per))
    df = docs.select(block.alias("block"), row.alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return bucketed(df, "block", max(8, min(1 << 16, math.ceil(estimated_bytes(docs) / (block_bytes * 1.3)))), what)


def chosen(rows: DataFrame, kept: DataFrame, schema: StructType) -> DataFrame:
    """The documents of the table rows (block, row, doc, ...), bucketed by block, that kept (row, block) names. No document moves."""

    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        t = t.filter(pa.compute.is_in(t.column("row"), value_set=r.column("row").combine_chunks()))
        return pa.Table.from_struct_array(t.column("doc").combine_chunks())

    return rows.select("doc", "row", "block").groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(f, schema)


def shared(spark: SparkSession, value: object) -> Callable:
    """A function that gives the value on executors, where it is sent once; it must be of bounded size."""
    sent, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get():
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    return get


def field(rows: pa.RecordBatch | pa.Table, path: str) -> pa.Array:
    """A column, or "column.field" of a struct."""
    name, _, inner = path.partition(".")
    col = rows.column(name)
    col = pa.compute.struct_field(col, inner) if inner else col
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text. column: as in field()."""
    for b in batches:
        col = field(b, column)
        sizes = np.nan_to_num(pa.compute.binary_length(col).to_numpy(zero_copy_only=False)).astype(np.int64)
        at = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(sizes)], strict=True):
            if z > a:
                yield b.slice(int(a), int(z - a))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[list[np.ndarray]]:
    """The columns of a stream of rows in order of its columns `keys`, cut so that rows with equal keys stay together."""
    held = None
    for b in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        own = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        if not len(own[0]):
            continue
        last = np.ones(len(own[0]), bool)
        for k in keys:
            last &= own[k] == own[k][-1]
        start = int(np.argmax(last))
        held = [x[start:] for x in own]
        if start:
            yield [x[:start] for x in own]
    if held is not None:
        yield held


def byte_list(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer with a line feed after each; where each starts, and its length."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), starts, sizes


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & M64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS: dict[tuple[int, str], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get((base, "p"))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & M64, np.uint64)
        steps[0] = 1
        have = _POWERS[base, "p"] = np.cumprod(steps)
        if len(have) > 16 << 20:  # one very long text: not kept
            del _POWERS[base, "p"]
    return have[:n]


class Rolling:
    """Polynomial hashes (modulo 2^64, then mixed) of any run of a sequence, by prefix sums."""

    BASES = ((0x5851F42D4C957F2D, 0), (0xD1342543DE82EF95, 1))

    def __init__(self, values: np.ndarray, which: int = 0):
        base, self.seed = self.BASES[which]
        inverse = pow(base, -1, 1 << 64)
        n = len(values)
        self.undo = powers(inverse, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * powers(base, n), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[ends] - self.sums[starts]) * self.undo[starts], self.seed)

    def windows(self, size: int) -> np.ndarray:
        """The hash of each run of `size` values."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[size:] - self.sums[:-size]) * self.undo[: len(self.sums) - size], self.seed)


#: A random 64-bit value for each byte, by a rule.
BYTE_VALUES = tuple(mix64(np.arange(256), 7 + i) for i in range(2))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends with a space character."""
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edges = np.flatnonzero(np.diff(space, prepend=True))
    return edges[0::2], edges[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return Rolling(BYTE_VALUES[which][buf], which).hashes(starts, ends)


def doc_of(positions: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(doc_starts, positions, "right") - 1


class HashArray:
    """Sorted 64-bit keys with a directory of their leading bits; find() gives row numbers, -1 for keys that aren't there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, min(22, int(math.log2(len(keys) + 1)) + 1)))
        slots = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        top = keys >> self.shift
        self.first = np.searchsorted(top, slots).astype(np.int32)
        self.steps = max(1, int(np.diff(self.first).max(initial=0)).bit_length() + 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> self.shift).astype(np.int32)
        lo, hi = self.first[slot], self.first[slot + 1]
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        last = np.int32(len(self.keys) - 1)
        out = np.full(len(keys), -1, np.int32)
        at = np.flatnonzero(lo < hi)
        lo, hi, keys = lo[at], hi[at], keys[at]
        while len(at):
            got = self.keys[np.minimum(lo, last)]
            hit = got == keys
            out[at[hit]] = lo[hit]
            go = got < keys
            lo = lo + np.int32(1)
            go &= lo < hi
            at, lo, hi, keys = at[go], lo[go], hi[go], keys[go]
        return out


