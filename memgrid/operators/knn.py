"""Nearest neighbours by cosine: exact, in blocks of vectors, and by an inverted file of cells with exact similarities."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a block. A vector goes to as many tasks as there are blocks.
BLOCK = 8192
#: What products of single width may be off by, and pairs of a row that are worked out one by one.
MARGIN, MANY = 1e-5, 64
#: Vectors that cell centres are fit on at most.
SAMPLE = 20_000
#: Vectors of the sample that are asked for to find how many cells to look into, and the recall that is wanted of them.
ASKED, RECALL = 500, 0.95


def closest(keys: np.ndarray, v: np.ndarray, other: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, w): for each of some vectors (keys, v) the k closest of others (other, w), all of length one or zero, ties to the smaller key.

    Products of half the width say which pairs can be among the k; these are worked out exactly. A row that has too many, as among
    copies, is worked out whole.
    """
    order = np.argsort(other, kind="stable")
    other, w = other[order], w[order]
    half = w.astype(np.float32)
    group = max(1, min(64, len(w) // (4 * k)))  # columns whose maximum is taken
    whole = len(w) // group * group
    most = int(np.unique(other, return_counts=True)[1].max())  # how often a key stands there, once as a rule
    out = []
    for at in range(0, len(v), 512):
        some, own = v[at : at + 512], keys[at : at + 512]
        near = some.astype(np.float32) @ half.T
        twins = np.searchsorted(other, own)
        for side in range(most):
            place = np.minimum(twins + side, len(other) - 1)
            same = np.flatnonzero(other[place] == own)
            near[same, place[same]] = -2
        tops = near[:, :whole].reshape(len(near), -1, group).max(axis=2)
        # k groups have a pair each that is no worse than this
        least = -np.partition(-tops, k - 1, axis=1)[:, k - 1] if tops.shape[1] >= k else np.full(len(near), -2, np.float32)
        fits = near >= (np.maximum(least - MARGIN, -1.5))[:, None]
        many = fits.sum(axis=1) > MANY
        fits[many] = False
        a, b = np.nonzero(fits)
        exact = np.round(np.einsum("ij,ij->i", some[a], w[b]), 6) + 0.0
        best = np.lexsort((b, -exact, a))
        a, b, exact = a[best], b[best], exact[best]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        kept = place < k
        out.append((own[a[kept]], other[b[kept]], exact[kept]))
        for at_row in np.array_split(np.flatnonzero(many), -(-int(many.sum()) // 64) or 1):
            if not len(at_row):
                continue
            full = np.round(some[at_row] @ w.T, 6) + 0.0
            full[near[at_row] == -2] = -2
            for _ in range(k):
                b = full.argmax(axis=1)  # the first, so the smallest key
                value = full[np.arange(len(b)), b]
                fine = value > -2
                out.append((own[at_row[fine]], other[b[fine]], value[fine]))
                full[np.arange(len(b)), b] = -2
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def unit(t: pa.Table, size: int) -> np.ndarray:
    """Vectors of length one, or zero."""
    v = np.concatenate([np.asarray(x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py())) for x in t["v"].chunks if len(x)]).reshape(-1, size)
    length = np.sqrt((v * v).sum(axis=1))
    return v / np.where(length > 0, length, np.inf)[:, None]


def product(k: int) -> Callable:
    """Of a group of rows (key, v, asks) the k closest of the rows that don't ask, for each that does: (src, dst, w). Rows whose `asks`
    is null do both, and rows of both kinds ask each other (see nearest())."""

    def f(t: pa.Table) -> pa.Table:
        asks, keys = t["asks"].to_pandas(), t["key"].to_numpy()
        v = unit(t, len(t["v"][0]))
        if asks.isna().all():
            pairs = [(np.arange(len(keys)), np.arange(len(keys)))]
        else:
            a, b = np.flatnonzero(asks.to_numpy(bool)), np.flatnonzero(~asks.to_numpy(bool))
            pairs = [(a, b), (b, a)] if "both" in t.column_names else [(a, b)]
        found = [closest(keys[a], v[a], keys[b], v[b], k) for a, b in pairs if len(a) and len(b)]
        src, dst, w = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (keys[:0], keys[:0], np.zeros(0))
        return pa.table({"src": pa.array(src), "dst": pa.array(dst), "w": pa.array(w, pa.float64())})

    return f


def best_of(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("n") <= k).drop("n")


def nearest_of(vectors: DataFrame, asks: Column, key: str, column: str, k: int, block: int = BLOCK) -> DataFrame:
    """nearest() for the few vectors that ask, over all: those that ask go to each block, all others move once, so the work is linear."""
    rows = vectors.where(F.size(column) > 0).withColumns({"_asks": asks, "_key": F.col(key), "_v": F.col(column).cast("array<double>")})
    rows = rows.select(F.col("_key").alias("key"), F.col("_v").alias("v"), "_asks")
    blocks = max(1, math.ceil(rows.count() / block))
    left = rows.where("_asks").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), "key", "v", F.lit(True).alias("asks"))
    right = rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("part"), "key", "v", F.lit(False).alias("asks"))
    kind = rows.schema["key"].dataType.simpleString()
    return best_of(left.unionByName(right).groupBy("part").applyInArrow(product(k), f"src {kind}, dst {kind}, w double"), k)


def nearest(vectors: DataFrame, key: str, column: str, k: int, block: int = BLOCK) -> DataFrame:
    """(src, dst, w): each vector's k closest others by cosine to 6 digits, ties to the smaller key.

    Vectors are cut into blocks by a hash of the key. Each pair of blocks is one matrix product in a task of its own, from which only k
    rows a vector leave; nothing that grows with the table is broadcast or held whole. Null and empty vectors have no neighbours; all
    others have one length. The work is quadratic: for large tables there is near_cells.
    """
    rows = vectors.where(F.size(column) > 0).select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v"))
    blocks = max(1, math.ceil(rows.count() / block))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # each pair of blocks once: the first asks the second and the other way round; a block asks itself
    asks = F.when(F.col("own") != F.col("other"), F.col("own") < F.col("other"))
    rows = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "v", asks.alias("asks"), F.lit(True).alias("both"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.groupBy("i", "j").applyInArrow(product(k), f"src {kind}, dst {kind}, w double")
    return best_of(found, k)


def centres(vectors: DataFrame, key: str, column: str, cells: int, k: int, sample: int = SAMPLE, rounds: int = 10, recall: float = RECALL) -> tuple[np.ndarray, int]:
    """Cell centres of norm one, by spherical k-means over `sample` vectors at most, chosen by a hash of the key (the driver holds no more),
    and how many cells a vector must look into so that of the sample's own neighbours a share of `recall` is found."""
    rows = vectors.where(F.size(column) > 0).orderBy(F.xxhash64(key, F.lit("cells")), key).select(column).limit(sample)
    v = np.array([r[0] for r in rows.collect()], np.float64)
    if not len(v):
        return np.zeros((0, 0)), 1
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    out = v[: min(cells, len(v))].copy()
    for _ in range(rounds):
        own = np.argmax(v @ out.T, axis=1)
        for c in range(len(out)):
            if (own == c).any():
                mean = v[own == c].mean(axis=0)
                out[c] = mean / max(np.linalg.norm(mean), 1e-12)
    asks = np.arange(min(ASKED, len(v)))
    w = v[asks] @ v.T
    w[asks, asks] = -2
    near = np.argsort(-w, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(v[asks] @ out.T), axis=1), axis=1)  # of each cell for each vector that asks
    deep = np.sort(np.take_along_axis(place, np.argmax(v @ out.T, axis=1)[near], axis=1).reshape(-1))
    return out, int(deep[min(len(deep) - 1, math.ceil(recall * len(deep)))]) + 1


def in_cells(rows: DataFrame, middle: np.ndarray, probes: int) -> DataFrame:
    """rows (key, v) with the `probes` cells that are closest to v, as an array."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            near = np.argsort(-(v @ middle.T), axis=1, kind="stable")[:, :probes] if b.num_rows else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.tolist(), pa.list_(pa.int64()))], ["key", "v", "cells"])

    return rows.mapInArrow(f, f"key {rows.schema['key'].dataType.simpleString()}, v array<double>, cells array<long>")


def near_cells(vectors: DataFrame, key: str, column: str, k: int, asks: Column | None = None, cells: int | None = None, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(src, dst, w): the k closest vectors that lie in the `probes` cells next to each vector that asks; similarities are exact.

    Every vector is in the cell of its closest centre. A cell is cut into blocks by a hash, so that a large one is several tasks; a vector
    meets each block of its cells. cells: the square root of the number of vectors, 4096 at most; probes: what the sample needs.
    """
    rows = vectors.where(F.size(column) > 0).select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v"))
    count = rows.count()
    middle, needed = centres(vectors, key, column, cells or max(1, min(4096, math.isqrt(count))), k)
    probes = probes or needed
    sizes = in_cells(rows, middle, 1).select(F.col("cells")[0].alias("cell"), "key", "v")
    counts = sizes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))  # a row a cell
    part = lambda c, n: F.pmod(F.xxhash64("key", F.lit(c)), F.col(n))
    right = sizes.join(F.broadcast(counts), "cell").select("cell", part("b", "parts").alias("j"), F.lit(0).cast("long").alias("i"), "parts", "key", "v")
    asking = rows if asks is None else vectors.where(asks).where(F.size(column) > 0).select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v"))
    left = in_cells(asking, middle, probes).select("key", "v", F.explode("cells").alias("cell")).join(F.broadcast(counts), "cell")
    left = left.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), part("a", "parts").alias("i"), "key", "v", F.lit(True).alias("asks"))
    right = right.select("cell", "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), "key", "v", F.lit(False).alias("asks"))
    kind = rows.schema["key"].dataType.simpleString()
    return best_of(left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(product(k), f"src {kind}, dst {kind}, w double"), k)
