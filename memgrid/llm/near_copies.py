"""Near copies by SimHash and pivots at a similarity that short fingerprint radii don't reach: Jaccard 0.8 of five-word shingles.

Bit blocks cannot index a radius of some 30 % of the bits, so documents meet by shingles: in one global order of all shingles, two sets
with that similarity share one of the first n - ceil(similarity * n) + 1 of each, whatever the order. None is missed. The order puts
shingles that many documents hold last (counts come from a sketch of fixed size over all documents), so common passages gather few.

A pair is looked at under its first common shingle: those before it are not shared, so where it stands bounds what the sets can have
in common, and pairs that cannot be similar by that are left out under this key (a similar pair never is under its first).

Documents with equal shingle sets are one class from the start, and of keys with the same members the first in the order is kept. Where classes meet:
1. Stars. Each key's members are compared with LEADERS of them, those that share most of their shingles; a large group of near copies
   becomes one component by some comparisons for each member. Leaders have then met all of their key and leave it, as do keys whose
   members are one component. STARS times.
2. Tiles. What is left compares the members outside the key's largest component with all, in tiles. Pivot distance tables discard pairs
   whose distances to any pivot differ by more than RADIUS, then the fingerprints' own distance decides who is verified: the NEAREST of
   each member first. A key where a member has more than that sends its members' sets into its tiles and is worked off there, so that
   no pairs are written.
Verification compares the shingle sets. A leader's or neighbour's set is sent once to each block of documents that needs it.

Fingerprints have 256 bits, of the distinct shingles: two sets at 0.8 differ in each bit with a probability of at most 0.152, so RADIUS is
six standard deviations over the mean (about one in 10^9 such pairs lies beyond), while sets that share little differ in 128 of them or
so. Sets are sets of 64-bit shingle hashes.

Defined results: texts without words are one class; a null doc_id comes after all others; among equal ids the first row stays;
repeated rows are copies of each other; an empty table gives an empty one; all columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from .components import components
from .decontaminate import fingerprint, lowered
from .simhash import PIVOTS, star

RADIUS, TILE = 74, 1024
#: Words of a fingerprint, 64 bits each.
PRINTS = ("p0", "p1", "p2", "p3")
#: Members of one key that meet in one task at most; more are dealt by a salt.
HOT = 4096
STARS, LEADERS = 2, 3
#: Survivors that a member of a tile is verified with before sets are sent to the tile.
NEAREST = 16
#: Rows named in a broadcast at most; where more are wanted, all texts are read instead.
MOST_BROADCAST = 500_000
#: The sketch: counters, and how they are cut for summing.
COUNTERS, CHUNK = 1 << 20, 1 << 10


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; a text of fewer words is one shingle."""
    hashes, _, first = lowered(texts)
    rolled = base.Rolling(hashes)
    every = rolled.windows(words) if len(hashes) >= words else np.zeros(0, np.uint64)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(every[a : z - words + 1] if z - a >= words else rolled.hashes(np.array([a]), np.array([z])) if z > a else every[:0])


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc, row, block, digest of the shingle set, size of it, PRINTS); doc holds the columns of docs."""
    per = max(1, min(64, base.split_bytes(docs) >> 22))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches, "doc.text"):
            digest, size, prints = [], [], []
            for own in shingle_sets(base.byte_list(base.field(b, "doc.text")), words):
                digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                size.append(len(own))
                prints.append([fingerprint(base.mix64(own, 20 + k)) if len(own) else 0 for k in range(len(PRINTS))])
            more = [pa.array(digest, pa.binary()), pa.array(size, pa.int64()), *map(pa.array, np.array(prints, np.uint64).view(np.int64).T)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "digest", "size", *PRINTS])

    row = F.monotonically_increasing_id()
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), row.alias("row"), (F.spark_partition_id().cast("long") * per + F.pmod(F.xxhash64(row), F.lit(per))).alias("block"))
    return packed.mapInArrow(f, f"doc {packed.schema['doc'].dataType.simpleString()}, row long, block long, digest binary, size long, {' long, '.join(PRINTS)} long")


def counters(docs: DataFrame, words: int) -> np.ndarray:
    """About how many documents hold the shingles of each counter, over all documents: COUNTERS numbers, whatever the input."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for b in base.slices(batches):
            for own in shingle_sets(base.byte_list(b.column(0)), words):
                np.add.at(total, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
        if total.any():
            parts = total.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.int64)
    for r in docs.select("text").mapInArrow(f, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


class Order:
    """The global order of shingles: what stands out of the sketch's usual load comes later, and needs a salt."""

    def __init__(self, counts: np.ndarray):
        usual = float(np.median(counts))
        over = np.maximum(counts - usual - 4 * math.sqrt(usual), 0)
        self.level = np.ceil(np.log2(over + 1)).astype(np.int8)
        self.salts = (1 + over // HOT).astype(np.int64)

    def first(self, own: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of the (sorted) set that must meet those of similar sets, and the salts of each."""
        n = len(own)
        at = (own % np.uint64(COUNTERS)).astype(np.int64)
        take = np.argsort(self.level[at], kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1] if n else np.zeros(0, np.int64)
        return own[take], self.salts[at[take]]


def key_sender(words: int, similarity: float, order: Callable) -> Callable:
    """(key, salts, salt, row, pos) of the block's rows that stand for a class; pos: how many of the set's shingles come before the key."""

    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("salts", pa.int64()), ("salt", pa.int64()), ("row", pa.int64()), ("pos", pa.int64())])
        t = t.filter(pa.compute.is_in(t.column("row"), value_set=r.column("row").combine_chunks())) if len(r) else t.slice(0, 0)
        if not len(t):
            return schema.empty_table()
        keys, salts, each, at = [], [], [], 0
        for b in base.slices(t.combine_chunks().to_batches(), "doc.text"):
            for own in shingle_sets(base.byte_list(base.field(b, "doc.text")), words):
                key, salt = order().first(own, similarity)
                keys.append(key)
                salts.append(salt)
                each.append(len(key))
        rows = np.repeat(t.column("row").to_numpy(), each)
        salts = np.concatenate(salts)
        salt = (base.mix64(rows.view(np.uint64), 5) % salts.view(np.uint64)).astype(np.int64)
        pos = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each)
        return pa.table([np.concatenate(keys).view(np.int64), salts, salt, rows, pos], schema=schema)

    return f


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, salts, salt, row, pos), in order of key and salt, those that have company, or may have it under another salt."""
    for c in base.whole_groups(batches, (0, 2)):
        same = (c[0][1:] == c[0][:-1]) & (c[2][1:] == c[2][:-1])
        keep = np.r_[False, same] | np.r_[same, False] | (c[1] > 1)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in c], ["key", "salts", "salt", "row", "pos"])


def set_sender(words: int) -> Callable:
    """(block, row, set): the shingle sets of the block's rows that are wanted in other blocks."""

    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("set", pa.binary())])
        if not len(r):
            return schema.empty_table()
        t = t.filter(pa.compute.is_in(t.column("row"), value_set=r.column("row").combine_chunks()))
        sets = own_sets(t, words)
        rows = r.column("row").to_pylist()
        return pa.table([r.column("to").combine_chunks(), pa.nulls(len(r), pa.int64()), r.column("row").combine_chunks(), pa.array([sets[x].tobytes() for x in rows], pa.binary())], schema=schema)

    return f


def own_sets(t: pa.Table, words: int) -> dict[int, np.ndarray]:
    sets = [own for b in base.slices(t.combine_chunks().to_batches(), "doc.text") for own in shingle_sets(base.byte_list(base.field(b, "doc.text")), words)]
    return dict(zip(t.column("row").to_pylist(), sets, strict=True))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def checker(words: int, similarity: float) -> Callable:
    """(a, b) of the block's pairs that are similar; r holds the pairs (a, b) and the sets of all b."""

    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not len(r):
            return schema.empty_table()
        sent = r.filter(pa.compute.is_null(r.column("a")))
        other = {k: np.frombuffer(x, np.uint64) for k, x in zip(sent.column("b").to_pylist(), sent.column("set").to_pylist(), strict=True)}
        pairs = r.filter(pa.compute.is_valid(r.column("a")))
        own = own_sets(t.filter(pa.compute.is_in(t.column("row"), value_set=pairs.column("a").combine_chunks())), words)
        a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
        good = [alike(own[x], other[y], similarity) for x, y in zip(a, b, strict=True)]
        return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_())).cast(schema)

    return f


FACTS = ("row", "block", "size", "root", "pos", *PRINTS)


def verified(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b): those of the pairs (a, a_block, b, b_block) whose sets are similar. texts: (doc, row, block), bucketed by block."""
    wanted = pairs.select(F.col("b_block").alias("block"), F.col("b").alias("row"), F.col("a_block").alias("to")).distinct()
    named = base.written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "named")
    if named.count() <= MOST_BROADCAST:
        texts = texts.join(F.broadcast(named), "row", "left_semi").select("doc", "row", "block")
    by_block = texts.groupBy("block")
    sets = by_block.cogroup(wanted.groupBy("block")).applyInArrow(set_sender(words), "block long, a long, b long, set binary")
    work = sets.unionByName(pairs.select(F.col("a_block").alias("block"), "a", "b", F.lit(None).cast("binary").alias("set")))
    return by_block.cogroup(work.groupBy("block")).applyInArrow(checker(words, similarity), "a long, b long")


def paired(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of rows (a_*, b_*) of two components whose sizes and fingerprints allow them to be similar, each once."""
    left = F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
    sizes = left >= similarity / (1 + similarity) * (F.col("a_size") + F.col("b_size")) - 1e-9
    far = F.lit(0)
    for p in PRINTS:
        far = far + F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}")))
    rows = rows.where((F.col("a") != F.col("b")) & (F.col("a_root") != F.col("b_root")) & sizes & (far <= RADIUS))
    return rows.select("a", "a_block", "b", "b_block").distinct()


def salted(keys: DataFrame, *columns: str) -> DataFrame:
    """Rows (key, salts, ...) once for each salt, as (_key, _salt, ...), to be joined with members of keys."""
    return keys.select(F.col("key").alias("_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("_salt"), *columns)


def at_key() -> Column:
    return (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt"))


def leaders(members: DataFrame) -> DataFrame:
    """(key, salts, top): each key's first LEADERS members by the share of their shingles that others have."""
    place = F.struct((-F.col("shared")).alias("place"), F.xxhash64("row").alias("hash"), *FACTS)
    top = F.slice(F.array_sort(F.collect_list(place)), 1, LEADERS)
    each = members.groupBy("key", "salts", "salt").agg(top.alias("top"))  # HOT rows or so
    return each.groupBy("key", "salts").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, LEADERS).alias("top"))


def star_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Each member of a key (with its leaders, top) with each of them."""
    rows = rows.withColumn("b", F.explode("top"))
    ends = [F.col(c).alias("a" if c == "row" else f"a_{c}") for c in FACTS] + [F.col(f"b.{c}").alias("b" if c == "row" else f"b_{c}") for c in FACTS]
    return paired(rows.select(*ends), similarity)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows, sorted by their first columns, in groups of equal ones; a group of one is left out."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != r[:keys]:
                if len(held) > 1:
                    yield held
                held = []
            held.append(r)
    if len(held) > 1:
        yield held


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, their words along the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def survivors(fps: np.ndarray, size: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> Iterator[tuple]:
    """Pairs (i, j, distance) of left and right, some of left at a time, that sizes, places, pivots and fingerprints don't rule out."""
    pivots = base.mix64(np.arange(PIVOTS * fps.shape[1]), 11).reshape(PIVOTS, -1)
    table = distances(fps[:, None], pivots[None])
    right = right[np.argsort(table[right, 0], kind="stable")]
    along = table[right, 0]
    for at in range(0, len(left), 128):
        some = left[at : at + 128]
        d = table[some, 0]
        a, z = np.searchsorted(along, d - RADIUS), np.searchsorted(along, d + RADIUS, "right")
        each = z - a
        i = np.repeat(some, each)
        j = right[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - a, each)]
        keep = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-9
        i, j = i[keep], j[keep]
        for k in range(1, PIVOTS):
            if len(i) < 32:
                break
            near = np.abs(table[i, k] - table[j, k]) <= RADIUS
            i, j = i[near], j[near]
        far = distances(fps[i], fps[j])
        near = far <= RADIUS
        yield i[near], j[near], far[near]


def columns_of(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """left, row, block, size, root, pos and fingerprints of rows (key, x, y, left, *FACTS, ...)."""
    first = np.array([r[3] for r in rows])
    numbers = np.array([r[4:13] for r in rows], np.int64)
    return first, *numbers[:, :5].T, numbers[:, 5:].view(np.uint64)


def nearest(similarity: float) -> Callable:
    """Of rows (key, x, y, left, *FACTS), in order of the tile pair: each left row with the NEAREST of its survivors.

    Rows (key, x, y, row) say who takes part in the pairs beyond.
    """
    names = ["a", "a_block", "b", "b_block", "key", "x", "y", "row"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, 3):
            first, row, block, size, root, pos, prints = columns_of(rows)
            found, beyond = [], np.zeros(len(rows), bool)
            for i, j, far in survivors(prints, size, pos, np.flatnonzero(first), np.flatnonzero(~first), similarity):
                other = root[i] != root[j]
                i, j, far = i[other], j[other], far[other]
                order = np.lexsort((row[j], far, i))
                i, j = i[order], j[order]
                heads = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
                place = np.arange(len(i)) - np.repeat(heads, np.diff(np.r_[heads, len(i)]))
                keep = place < NEAREST
                beyond[i[~keep]] = beyond[j[~keep]] = True
                found.append((i[keep], j[keep]))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            more = np.array([r[0:3] for r, ok in zip(rows, beyond, strict=True) if ok], np.int64).reshape(-1, 3)
            # a row may stand on both sides of its tile
            pairs = [pa.array(x, pa.int64()) for x in (row[i], block[i], row[j], block[j])]
            rest = [pa.array(x, pa.int64()) for x in (*more.T, row[beyond])]
            if len(i) or len(more):
                columns = [pa.concat_arrays([x, pa.nulls(len(more), pa.int64())]) for x in pairs] + [pa.concat_arrays([pa.nulls(len(i), pa.int64()), x]) for x in rest]
                yield pa.RecordBatch.from_arrays(columns, names)

    return f


def tiles(members: DataFrame) -> DataFrame:
    """(key, x, y, left, *FACTS): members of a key outside its largest component (left) against all its members, in pairs of tiles."""
    roots = members.groupBy("key", "salts", "root").agg(F.count(F.lit(1)).alias("n"))
    main = roots.groupBy("key", "salts").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.select("key", "salts", "main", F.ceil(F.col("all") / TILE).alias("rights"), F.ceil((F.col("all") - F.col("most")) / TILE).alias("lefts"))
    rows = members.join(salted(main, "main", "lefts", "rights"), at_key())
    tile = lambda n: F.pmod(F.xxhash64("row", F.lit(9)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("root <> main").select("key", tile("lefts").alias("x"), every("rights").alias("y"), F.lit(True).alias("left"), *FACTS)
    right = rows.select("key", every("lefts").alias("x"), tile("rights").alias("y"), F.lit(False).alias("left"), *FACTS)
    return left.unionByName(right)


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def tile_sender(words: int) -> Callable:
    """The tile rows of a block, each with its document's set."""

    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        names = ["key", "x", "y", "left", *FACTS]
        r = r.select(names)
        if not len(r):
            return r.append_column("set", pa.nulls(0, pa.binary()))
        sets = own_sets(t.filter(pa.compute.is_in(t.column("row"), value_set=r.column("row").combine_chunks())), words)
        return r.append_column("set", pa.array([sets[x].tobytes() for x in r.column("row").to_pylist()], pa.binary()))

    return f


def tile_links(similarity: float) -> Callable:
    """Stars (a, b) of the similar pairs of each pair of tiles (both sides in one); a pair that is linked already is not compared."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, 3):
            _, row, _, size, root, pos, prints = columns_of(rows)
            every = np.arange(len(rows))
            sets = [np.frombuffer(r[13], np.uint64) for r in rows]
            _, label = np.unique(root, return_inverse=True)
            heads = np.full(len(rows), len(rows))
            np.minimum.at(heads, label, np.arange(len(rows)))
            label = heads[label]
            before = label.copy()
            for i, j, far in survivors(prints, size, pos, every, every, similarity):
                for k in np.argsort(far, kind="stable").tolist():
                    x, y = int(i[k]), int(j[k])
                    if x < y and label[x] != label[y] and alike(sets[x], sets[y], similarity):
                        star(label, np.array([x]), np.array([y]))
            moved = np.flatnonzero(label != before)
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(row[moved]), pa.array(row[label[moved]])], ["a", "b"])

    return f


def tile_rounds(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) from the tiles of all keys."""
    schema = ", ".join(f"{c} long" for c in ("a", "a_block", "b", "b_block", "key", "x", "y", "row"))
    found = base.written(in_order(tiles(members)).mapInArrow(nearest(similarity), schema).distinct(), "pairs")
    links = verified(texts, found.where("a is not null").select("a", "a_block", "b", "b_block"), words, similarity)
    more = found.where("a is null").select("key", "x", "y", "row")
    if more.isEmpty():
        return links
    # tiles with the same rows are one; places say nothing there
    same = more.groupBy("key", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("h"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("i"))
    one = same.groupBy("n", "h", "i").agg(F.min(F.struct("key", "x", "y")).alias("k")).select("k.*")
    facts = members.select(*(c for c in FACTS if c != "pos")).distinct().withColumn("pos", F.lit(0).cast("long"))
    crowded = base.written(more.join(one, ["key", "x", "y"], "left_semi").join(facts, "row").select("key", "x", "y", F.lit(True).alias("left"), *FACTS), "crowded")
    sent = texts.groupBy("block").cogroup(crowded.groupBy("block")).applyInArrow(tile_sender(words), f"{', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in crowded.schema)}, set binary")
    return links.unionByName(in_order(sent).mapInArrow(tile_links(similarity), "a long, b long"))


def meeting(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, salts, salt, *FACTS, shared): members of keys; of keys with the same members one. shared: the part of a set that is keys."""
    found = base.written(keys.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(met, "key long, salts long, salt long, row long, pos long"), "met")
    same = found.groupBy("key", "salts").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"), F.sum("pos").alias("pos")).where("n > 1")
    one = same.groupBy("n", "x", "y").agg(F.min(F.struct("pos", "key", "salts")).alias("k")).select("k.key", "k.salts")
    shared = found.groupBy(F.col("row").alias("_row")).agg(F.count(F.lit(1)).alias("shared"))
    facts = classes.select("row", "block", "size", *PRINTS, F.col("row").alias("root")).join(shared, F.col("row") == F.col("_row"))
    facts = facts.select("_row", "block", "size", *PRINTS, "root", (F.col("shared") / F.col("size")).alias("shared"))
    found = found.join(salted(one), at_key(), "left_semi")
    return base.written(found.join(facts, F.col("row") == F.col("_row")).select("key", "salts", "salt", *FACTS, "shared"), "members")


def apart(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """members with their component as root, without keys that lie in one component."""
    if roots is not None:
        members = members.drop("root").join(roots, F.col("row") == F.col("node"), "left").withColumn("root", F.coalesce("root", "row")).drop("node")
    mixed = members.groupBy("key", "salts").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return base.written(members.join(salted(mixed), at_key(), "left_semi"), "mixed")


def links(rows: DataFrame, classes: DataFrame, order: Callable, words: int, similarity: float) -> DataFrame:
    """(node, root) of all classes (by their row) that are linked to another. rows: (doc, row, block, ...), bucketed by block."""
    keys = rows.select("doc", "row", "block").groupBy("block").cogroup(classes.select("block", "row").groupBy("block")).applyInArrow(key_sender(words, similarity, order), "key long, salts long, salt long, row long, pos long")
    members = meeting(keys, classes)
    texts = rows.join(members.select("row").distinct(), "row", "left_semi").select("doc", "row", "block")
    texts = base.bucketed(texts, "block", base.parts_for(rows, 8 << 20), "meeting")
    roots = None

    def joined(new: DataFrame) -> DataFrame | None:
        new = base.written(new, "links")
        if new.isEmpty():
            return roots
        # earlier components are links themselves: their stars
        return components(new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    for _ in range(STARS):
        if members.isEmpty():
            break
        rows = base.written(members.join(salted(leaders(members), "top"), at_key()).drop("_key", "_salt"), "stars")
        pairs = base.written(star_pairs(rows, similarity), "pairs")
        roots = joined(verified(texts, pairs, words, similarity))
        members = apart(rows.where(~F.exists("top", lambda x: x["row"] == F.col("row"))).drop("top"), roots)
    if not members.isEmpty():
        roots = joined(tile_rounds(members, texts, words, similarity))
    return roots if roots is not None else rows.sparkSession.createDataFrame([], "node long, root long")


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: that of the least doc_id."""
    rows = base.bucketed(sketched(docs, words), "block", base.parts_for(docs, 8 << 20), "sketches")
    order = base.shared(docs.sparkSession, Order(counters(docs, words)))
    place = F.struct(F.coalesce(F.col("doc.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col("row"), F.col("block"))
    classes = rows.groupBy("digest").agg(F.min(place).alias("first"), F.min("size").alias("size"), *(F.min(p).alias(p) for p in PRINTS))
    classes = base.written(classes.select("first.id", "first.row", "first.block", "size", *PRINTS), "classes")
    roots = links(rows, classes, order, words, similarity)
    named = classes.join(roots, F.col("row") == F.col("node"), "left").select("id", "row", "block", F.coalesce("root", "row").alias("root"))
    kept = named.groupBy("root").agg(F.min(F.struct("id", "row", "block")).alias("first")).select("first.row", "first.block")
    return base.chosen(rows, kept, docs.schema)
