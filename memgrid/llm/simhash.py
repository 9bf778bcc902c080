"""SimHash near-dedup with pivot distance tables.

Distinct fingerprints (each with the least doc_id that has it) are what is compared, so exact copies cost nothing. Fingerprints within
the radius agree on at least blocks - radius of their bit blocks, so all of them meet in some bucket of equal chosen blocks. In a
bucket the Hamming distances of each fingerprint to reference fingerprints (pivots) are tabulated. By the triangle inequality two
fingerprints within the radius differ by at most that in every coordinate: pairs with a larger difference in any are discarded, and
the survivors are verified. A large bucket is cut into tiles by hash, and each pair of tiles is a task's work, so no bucket is
gathered in one place; links leave a tile as stars, never as all pairs.

Defined results: a null or wordless text has fingerprint 0 and is linked like any other; a null doc_id never names a component
unless all ids of it are null; repeated rows stay, each with its result; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .components import components

PIVOTS = 24
TILE = 2048


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of so many words, lower-cased in A-Z and joined by one space; the whole sequence if it is shorter."""
    own = text.lower().split()
    if len(own) <= words:
        return [b" ".join(own)] if own else []
    line = b" ".join(own)
    ends = list(itertools.accumulate(len(w) + 1 for w in own))
    return [line[a : z - 1] for a, z in zip([0, *ends], ends[words - 1 :], strict=False)]


def fingerprint_of(text: bytes, words: int) -> int:
    parts = shingles(text, words)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for i in range(0, len(parts), 1 << 16):
        some = parts[i : i + (1 << 16)]
        hashes = np.fromiter((digest(x, 42) for x in some), np.uint64, len(some))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(parts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint) of every row; the fingerprint's 64 bits as a long."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches):
            found = np.fromiter((fingerprint_of(x, words) for x in base.byte_list(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(f, "doc_id long, fingerprint long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    pivots = base.mix64(np.arange(PIVOTS), 11)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def star(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the classes of i and j in label, where each class is named by its least member."""
    while len(i):
        a, b = label[i], label[j]
        go = a != b
        if not go.any():
            return
        i, j, a, b = i[go], j[go], a[go], b[go]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while (np.take(label, label) != label).any():
            label[:] = label[label]


def linked(fps: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """The class (least position) of each fingerprint, linked within `left`, or across left and right."""
    label = np.arange(len(fps))
    other = left if right is None else right
    other = other[np.argsort(table[other, 0], kind="stable")]
    along = table[other, 0].astype(np.int64)
    own = left[np.argsort(table[left, 0], kind="stable")]
    for at in range(0, len(own), 256):
        some = own[at : at + 256]
        d = table[some, 0].astype(np.int64)
        a, z = np.searchsorted(along, d - radius), np.searchsorted(along, d + radius, "right")
        each = z - a
        i = np.repeat(some, each)
        j = other[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - a, each)]
        if right is None:
            keep = i < j
            i, j = i[keep], j[keep]
        for k in range(1, PIVOTS):
            if len(i) < 32:
                break
            near = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        star(label, i[near], j[near])
    return label


def linker(radius: int) -> Callable:
    """Stars (a, b) that link the fingerprints of each group; rows (which, key, lo, hi, tile, fingerprint) come in order of the first four."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which, key, lo, hi, tile, fps in base.whole_groups(batches, (0, 1, 2, 3)):
            fps = fps.view(np.uint64)
            order = np.lexsort((fps, hi, lo, key, which))
            which, key, lo, hi, tile, fps = (c[order] for c in (which, key, lo, hi, tile, fps))
            new = np.ones(len(fps), bool)
            new[1:] = (np.diff(which) != 0) | (np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)
            heads = np.flatnonzero(new)
            a, b = [fps[:0]], [fps[:0]]
            for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(fps)], strict=True):
                if e - s < 2:
                    continue
                own = fps[s:e]
                n = np.arange(e - s)
                if lo[s] == hi[s]:
                    label = linked(own, pivot_table(own), n, None, radius)
                else:
                    first = tile[s:e] == lo[s]
                    label = linked(own, pivot_table(own), n[first], n[~first], radius)
                child = np.flatnonzero(label != n)
                a.append(own[child])
                b.append(own[label[child]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return f


def bit_blocks(count: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of so many nearly equal blocks of 64 bits."""
    cuts = [round(64 * i / count) for i in range(count + 1)]
    return [(a, z - a) for a, z in itertools.pairwise(cuts)]


def links(fps: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b): stars that connect exactly those of the distinct fingerprints that chains of pairs within the radius connect.

    blocks: bit blocks, over radius; a bucket is one value of blocks - radius of them. More blocks make more and finer buckets.
    """
    if blocks is None:
        n = fps.count()
        blocks = next((m for m in range(radius + 1, radius + 4) if n < 64 << (64 * (m - radius) // m)), radius + 4)
    parts = bit_blocks(blocks)
    fp = F.col("fingerprint")
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        key = F.lit(0).cast("long")
        for c in chosen:
            first, size = parts[c]
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << size) - 1)))
        keys.append(F.struct(F.lit(number).alias("which"), key.alias("key")))
    rows = fps.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("fingerprint", "k.which", "k.key")
    large = rows.groupBy("which", "key").count().where(F.col("count") > TILE).select("which", "key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    rows = rows.join(large, ["which", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles").cast("long")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("which", "key", F.least("tile", "with").alias("lo"), F.greatest("tile", "with").alias("hi"), "tile", "fingerprint")
    rows = rows.repartition("which", "key", "lo", "hi").sortWithinPartitions("which", "key", "lo", "hi")
    return rows.mapInArrow(linker(radius), "a long, b long")


def near_groups(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for rows (doc_id, fingerprint). component_id: the least doc_id that chains of links reach."""
    fps = base.written(fps, "fingerprints")
    distinct = base.written(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fingerprint"), radius))
    named = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fingerprint", "component_id")
    return fps.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(fingerprints(base.documents(spark, sf_dir), 4), 4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
