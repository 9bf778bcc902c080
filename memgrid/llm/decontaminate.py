"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

Every window of a document that has an item's number of words is looked at, in all shifts. The similarity of window and item is the
weighted Jaccard similarity of their multisets of five-word shingles, a shingle weighing log(1 + items / items that have it), counted
over the whole benchmark; it must be at least 0.8. Three steps get there:
1. Documents. A similar window shares over 0.8 of the item's weight, so at least one of the item's rarest shingles with over 0.2 of
   it; an inverted index of those names the items a document can hold, and a rolling sum of shared weight the windows that can be it.
   Both are bounds of the similarity, no window at 0.8 is left out.
2. Fingerprints. Those windows get a SimHash by rolling votes, each shingle voting with the root of its weight. Items are indexed by
   RADIUS + 1 bit blocks: one within the radius agrees on a block at least, so all fingerprints within the radius are found.
   Two multisets at 0.8 have a cosine of at least 0.888 under these votes, so a bit differs with a probability of at most 0.152, and
   RADIUS lies five standard deviations over the mean.
3. The exact similarity decides; of an item's windows in a document the best is reported, the first among equals.

The benchmark goes to executors in blocks of at most BLOCK_BYTES of text, each checked against all documents in one pass; weights don't
depend on the blocks.

Defined results: words are lower-cased in A-Z; null and wordless texts and items match nothing; an item of fewer than five words is
one shingle; a document shorter than an item is one window; repeated items each match, repeated documents each give their matches; an
empty documents or benchmark table gives no match; other columns are ignored (or kept, where documents are filtered).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .simhash import bit_blocks

WORDS, SIMILARITY, RADIUS = 5, 0.8, 24
BLOCK_BYTES = 16 << 20
#: Windows whose votes are added up at once.
WINDOWS = 4096


def lowered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the document of each, and where each document's words start (one more than documents)."""
    buf, starts, _ = base.joined([t.lower() for t in texts])
    a, z = base.word_bounds(buf)
    doc = base.doc_of(a, starts)
    return base.word_hashes(buf, a, z), doc, np.searchsorted(doc, np.arange(len(texts) + 1))


def fingerprint(hashes: np.ndarray) -> int:
    votes = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def window_prints(hashes: np.ndarray, votes: np.ndarray, starts: np.ndarray, size: int) -> list[int]:
    """The SimHash of each run of `size` hashes at starts (ascending), each hash with its votes."""
    out: list[int] = []
    for at in range(0, len(starts), WINDOWS):
        some = starts[at : at + WINDOWS]
        cuts = np.flatnonzero(np.diff(some) > size) + 1
        for own in np.split(some, cuts):
            a, z = int(own[0]), int(own[-1]) + size
            bits = np.unpackbits(np.ascontiguousarray(hashes[a:z]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.zeros((z - a + 1, 64))
            np.cumsum((bits * 2.0 - 1.0) * votes[a:z, None], axis=0, out=sums[1:])
            above = sums[own - a + size] - sums[own - a] > 1e-9
            out.extend(np.packbits(above, axis=1, bitorder="little").view(np.uint64).reshape(-1).tolist())
    return out


class Index:
    """Multi-index Hamming blocks: fingerprints by the value of each of RADIUS + 1 bit blocks."""

    def __init__(self, prints: list[int], groups: list):
        """groups: a fingerprint is only found under its own group."""
        self.prints = prints
        self.blocks = bit_blocks(RADIUS + 1)
        self.found: dict[tuple, list[int]] = defaultdict(list)
        for k, (fp, group) in enumerate(zip(prints, groups, strict=True)):
            for b, (at, n) in enumerate(self.blocks):
                self.found[group, b, (fp >> at) & ((1 << n) - 1)].append(k)

    def near(self, fp: int, group: object) -> set[int]:
        """All fingerprints of the group within RADIUS."""
        same = {k for b, (at, n) in enumerate(self.blocks) for k in self.found.get((group, b, (fp >> at) & ((1 << n) - 1)), ())}
        return {k for k in same if (fp ^ self.prints[k]).bit_count() <= RADIUS}


class Item:
    def __init__(self, name: object, hashes: np.ndarray, rarity: dict[int, int], total: int):
        """hashes: of the words; rarity: in how many of the `total` items each shingle is."""
        self.name, self.size, self.width = name, len(hashes), min(WORDS, len(hashes))
        self.shingles = base.Rolling(hashes).windows(self.width)
        self.keys, self.times = np.unique(self.shingles, return_counts=True)
        self.rarity = np.array([rarity[h] for h in self.keys.tolist()], np.float64)
        self.weights = np.log1p(total / self.rarity)
        mass = self.weights * self.times
        self.mass = float(mass.sum())
        order = np.lexsort((self.keys, self.rarity))
        enough = np.searchsorted(np.cumsum(mass[order]), (1 - SIMILARITY) * self.mass * (1 + 1e-9), "right") + 1
        self.rarest = self.keys[order[:enough]]

    def shared(self, shingles: np.ndarray) -> np.ndarray:
        """The weight of each of the shingles that the item has, else zero."""
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        return np.where(self.keys[at] == shingles, self.weights[at], 0.0)


class Benchmark:
    """A block of items, with what finds them."""

    def __init__(self, items: list[Item], total: int):
        self.items = items
        self.most = float(np.log1p(total))
        self.starts: dict[int, tuple] = {}
        self.weights: dict[int, tuple] = {}
        for width in {x.width for x in items}:
            own = [(k, x) for k, x in enumerate(items) if x.width == width]
            keys = np.concatenate([x.rarest for _, x in own])
            number = np.repeat([k for k, _ in own], [len(x.rarest) for _, x in own])
            order = np.lexsort((number, keys))
            heads, first = np.unique(keys[order], return_index=True)
            self.starts[width] = base.HashArray(heads), np.r_[first, len(keys)], number[order]
            every, at = np.unique(np.concatenate([x.keys for _, x in own]), return_index=True)
            self.weights[width] = every, np.concatenate([x.weights for _, x in own])[at]
        prints = [window_prints(x.shingles, np.sqrt(x.shared(x.shingles)), np.array([0]), len(x.shingles))[0] for x in items]
        self.index = Index(prints, [x.size for x in items])

    def weighed(self, shingles: np.ndarray, width: int) -> np.ndarray:
        """Each shingle's weight; one that no item has weighs as much as one that a single item has."""
        keys, weights = self.weights[width]
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        return np.where(keys[at] == shingles, weights[at], self.most)

    def similarity(self, window: np.ndarray, item: Item) -> float:
        keys, times = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(item.keys, keys), len(item.keys) - 1)
        same = item.keys[at] == keys
        both = float((np.minimum(times, item.times[at]) * item.weights[at])[same].sum())
        total = float((times * self.weighed(keys, item.width)).sum()) + item.mass - both
        return both / total if total else 0.0

    def possible(self, rolled: np.ndarray, first: np.ndarray, width: int) -> list[tuple[int, int]]:
        """(document, item) where the document has one of the item's rarest shingles."""
        keys, cuts, number = self.starts[width]
        found = keys.find(rolled)
        hits = np.flatnonzero(found >= 0)
        doc = np.searchsorted(first, hits, "right") - 1
        inside = hits + width <= first[doc + 1]
        doc, slot = doc[inside], found[hits[inside]]
        pairs = np.unique(np.stack([doc, slot], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        each = cuts[pairs[:, 1] + 1] - cuts[pairs[:, 1]]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - cuts[pairs[:, 1]], each)
        out = np.stack([np.repeat(pairs[:, 0], each), number[at]], 1)
        return [tuple(x) for x in np.unique(out, axis=0).tolist()]

    def windows(self, own: np.ndarray, item: Item, words: int) -> tuple[np.ndarray, int]:
        """Starts of the windows of a document's shingles that share enough weight with the item, and their number of shingles."""
        size = min(item.size, words) - item.width + 1
        sums = np.concatenate([[0.0], np.cumsum(item.shared(own))])
        return np.flatnonzero(sums[size:] - sums[:-size] >= SIMILARITY * item.mass * (1 - 1e-9)), size

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
        """(document, item, similarity, first word, word after the last): the best window of each item in each document."""
        hashes, _, first = lowered(texts)
        out = []
        for width in self.starts:
            if len(hashes) < width:
                continue
            rolled = base.Rolling(hashes).windows(width)
            wanted: dict[tuple[int, int], dict[int, np.ndarray]] = defaultdict(dict)
            for d, k in self.possible(rolled, first, width):
                a, z = int(first[d]), int(first[d + 1])
                at, size = self.windows(rolled[a : z - width + 1], self.items[k], z - a)
                if len(at):
                    wanted[d, self.items[k].size, size][k] = at
            for (d, words, size), items in wanted.items():
                a, z = int(first[d]), int(first[d + 1])
                own = rolled[a : z - width + 1]
                starts = np.unique(np.concatenate(list(items.values())))
                prints = window_prints(own, np.sqrt(self.weighed(own, width)), starts, size)
                allowed = {k: set(at.tolist()) for k, at in items.items()}
                best: dict[int, tuple] = {}
                for s, fp in zip(starts.tolist(), prints, strict=True):
                    for k in self.index.near(fp, words) & allowed.keys():
                        if s in allowed[k] and (found := self.similarity(own[s : s + size], self.items[k])) >= SIMILARITY - 1e-12 and found > best.get(k, (0,))[0]:
                            best[k] = (found, s, min(s + words, z - a))
                out.extend((d, k, *x) for k, x in best.items())
        return sorted(out)


def counted_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, shingles, items): the distinct shingles of each item with words, and how many items of the whole benchmark have each."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches):
            hashes, _, first = lowered(base.byte_list(b.column(1)))
            sets = [np.unique(base.Rolling(own).windows(min(WORDS, len(own)))) for own in np.split(hashes, first[1:-1]) if len(own)]
            row = np.repeat(b.column(0).to_numpy()[np.diff(first) > 0], [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["row", "shingle"])

    items = base.written(benchmark.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "item_id", "text"), "items")
    own = items.select("row", "text").mapInArrow(f, "row long, shingle long")
    counts = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("items"))
    own = own.join(counts, "shingle").groupBy("row").agg(F.collect_list(F.struct("shingle", "items")).alias("own"))
    return base.written(items.join(own, "row").select("item_id", "text", F.col("own.shingle").alias("shingles"), F.col("own.items").alias("items")), "weights")


def loaded(benchmark: DataFrame) -> Iterator[Callable]:
    """The benchmark in blocks, each shared with the executors."""
    rows = counted_items(benchmark)
    total = rows.count()
    items, size = [], 0
    for r in rows.toLocalIterator():
        raw = r["text"].encode("utf-8", "surrogatepass")
        rarity = {h & base.M64: n for h, n in zip(r["shingles"], r["items"], strict=True)}
        items.append(Item(r["item_id"], lowered([raw])[0], rarity, total))
        size += len(raw)
        if size > BLOCK_BYTES:
            yield base.shared(benchmark.sparkSession, Benchmark(items, total))
            items, size = [], 0
    if items:
        yield base.shared(benchmark.sparkSession, Benchmark(items, total))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, end): which items a document holds, and the words of the best window."""
    kinds = [frame.schema[c].dataType.simpleString() for frame, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start long, end long"

    def finder(block: Callable) -> Callable:
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in base.slices(batches):
                if found := block().matches(base.byte_list(b.column(1))):
                    d, k, similarity, start, end = zip(*found, strict=True)
                    items = pa.array([block().items[j].name for j in k])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), items, pa.array(similarity), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "similarity", "start", "end"])

        return f

    out = docs.sparkSession.createDataFrame([], schema)
    for block in loaded(benchmark):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(finder(block), schema))
    return out


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item, all columns as they are."""

    def keeper(block: Callable) -> Callable:
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in base.slices(batches):
                good = np.ones(b.num_rows, bool)
                good[[x[0] for x in block().matches(base.byte_list(b.column("text")))]] = False
                yield b.filter(pa.array(good))

        return f

    for block in loaded(benchmark):
        docs = docs.mapInArrow(keeper(block), docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(base.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
