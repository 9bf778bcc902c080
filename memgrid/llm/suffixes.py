"""Suffix-array dedup over bytes: repeated strings of a fixed size, found by sorting suffixes with a deep-shallow sort.

Suffixes of all positions need not be sorted. In each window of `size` bytes the piece of GRAM bytes with the least hash is its
anchor, the same one wherever the window's content occurs. So windows fall into runs that share an anchor, and only runs whose anchor
occurs in the corpus twice can hold a repeat. Round one sends four bytes for each distinct anchor of a block and gets a bit back.
Round two sends the bytes of the runs that are left, each distinct content of a block once with its least doc_id, to the part that
their anchor belongs to. There the suffixes that start in these runs are sorted: multikey quicksort, eight bytes a character, orders
them to a shallow depth, and blind tries order what still ties. Equal neighbours of the sorted order are the repeats; a mask of windows
goes back for each run. So this is a suffix array of what can repeat, not of the whole corpus. Hashes propose, bytes decide.

Texts stay in one table bucketed by block. Hot contents are sent once a block.

Defined results: a null text is an empty one; a text shorter than `size` loses nothing; a null doc_id counts as larger than any
other; rows that share a doc_id do not remove bytes of each other; matches never cross documents; an empty table gives an empty
result; columns other than doc_id and text are ignored. What is kept can end amid a code point, so it is binary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, substrings

GRAM = 26
#: Depth in bytes of the multikey quicksort; what ties beyond it goes to blind tries.
SHALLOW = 24
MESSAGE = "level int, part int, block long, a binary, lens binary, text binary, least binary, hash binary"
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


class Trie:
    """A blind trie: inner nodes keep only the position where their strings differ, and an insertion compares with one leaf."""

    def __init__(self, size: int):
        self.size, self.root = size, None

    def insert(self, key: int, item: list[int]) -> None:
        """key: the string as a big-endian number."""
        if self.root is None:
            self.root = (key, item)
            return
        at = self.root
        while isinstance(at, dict):
            at = at["next"].get(self.byte(key, at["depth"])) or next(iter(at["next"].values()))
        if at[0] == key:
            at[1].extend(item)
            return
        depth = self.size - ((at[0] ^ key).bit_length() + 7) // 8
        above, byte, at, seen = None, 0, self.root, at[0]
        while isinstance(at, dict) and at["depth"] < depth:
            above, byte = at, self.byte(key, at["depth"])
            at = at["next"][byte]
        if isinstance(at, dict) and at["depth"] == depth:
            at["next"][self.byte(key, depth)] = (key, item)
            return
        node = {"depth": depth, "next": {self.byte(seen, depth): at, self.byte(key, depth): (key, item)}}
        if above is None:
            self.root = node
        else:
            above["next"][byte] = node

    def byte(self, key: int, depth: int) -> int:
        return (key >> (8 * (self.size - 1 - depth))) & 255

    def leaves(self):
        """The items of equal strings, in the strings' order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            at = stack.pop()
            if isinstance(at, dict):
                stack.extend(at["next"][k] for k in sorted(at["next"], reverse=True))
            else:
                yield at[1]


def multikey(words: np.ndarray, starts: np.ndarray, order: np.ndarray, new: np.ndarray, limit: int) -> None:
    """Multikey quicksort to a depth of `limit` bytes, eight bytes a character; order and new (where strings differ from the one before) are set in place.

    Each group of strings that tie so far is split in three by a pivot character at its depth: smaller, equal, larger. Equal ones tie to a
    greater depth. All groups take their step at once.
    """
    depth = np.zeros(len(order), np.int32)
    at = np.arange(len(order)) if limit else np.zeros(0, np.int64)
    while len(at):
        heads = np.flatnonzero(np.r_[True, new[at[1:]]])
        sizes = np.diff(np.r_[heads, len(at)])
        keep = np.repeat((sizes > 1) & (depth[at[heads]] < limit), sizes)
        at = at[keep]
        if not len(at):
            return
        heads = np.flatnonzero(np.r_[True, new[at[1:]]])
        sizes = np.diff(np.r_[heads, len(at)])
        key = words[starts[order[at]] + depth[at]].astype(np.uint64)
        a, b, c = key[heads], key[heads + sizes // 2], key[heads + sizes - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), sizes)
        smaller, equal = key < pivot, key == pivot
        n_smaller, n_equal = np.add.reduceat(smaller, heads, dtype=np.int64), np.add.reduceat(equal, heads, dtype=np.int64)
        moved = np.empty(len(at), np.int64)
        tied = np.zeros(0, np.int64)
        own_order = order[at]
        parts = ((smaller, n_smaller, heads), (equal, n_equal, heads + n_smaller), (~(smaller | equal), sizes - n_smaller - n_equal, heads + n_smaller + n_equal))
        for k, (own, many, start) in enumerate(parts):
            to = np.repeat(start - np.cumsum(many) + many, many)
            to += np.arange(len(to))
            moved[to] = own_order[own]
            tied = to if k == 1 else tied
        order[at] = moved
        depth[at[tied]] += 8
        cut = heads + n_smaller
        new[at[cut[n_smaller > 0]]] = True
        cut = heads + n_smaller + n_equal
        new[at[cut[cut < heads + sizes]]] = True


def deep_shallow(buf: np.ndarray, starts: np.ndarray, size: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of `size` bytes at starts, and where in that order a string differs from the one before."""
    n = len(starts)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), ">u8", padded, strides=(1,))
    order, new = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, new
    new[0] = True
    depth = min(shallow, size - size % 8)
    multikey(words, starts, order, new, depth)
    alone = new & np.r_[new[1:], True]
    tied = np.flatnonzero(~alone)
    if not len(tied):
        return order, new
    heads = np.flatnonzero(new)
    group = np.cumsum(new)[tied] - 1
    head = starts[order[heads[group]]]
    own = starts[order[tied]]
    same = np.ones(len(tied), bool)
    for at in [*range(depth, size - 7, 8), max(size - 8, 0)] if size >= 8 else [0]:
        same &= words[own + at] == words[head + at]
    if size < 8:
        same[:] = False
    mixed = np.unique(group[~same])
    ends = np.r_[heads[1:], n]
    for g in mixed.tolist():
        a, z = int(heads[g]), int(ends[g])
        trie = Trie(size)
        for i in order[a:z].tolist():
            s = int(starts[i])
            trie.insert(int.from_bytes(buf[s : s + size].tobytes(), "big"), [i])
        for item in trie.leaves():
            order[a : a + len(item)] = item
            new[a + 1 : a + len(item)] = False
            new[a] = True
            a += len(item)
    return order, new


class Block:
    """A block's texts and its runs of windows: start, number of windows, owner, anchor's part and short hash."""

    def __init__(self, t: pa.Table, size: int, parts: int):
        t = substrings.block_docs(t)
        self.size, self.gram = size, min(GRAM, size)
        self.doc_ids, self.ids = t["doc_id"], substrings.ids_of(t)
        self.texts = base.byte_list(t["text"].combine_chunks())
        self.buf, self.starts, self.sizes = base.joined(self.texts)
        found = [self.runs(first, len(texts)) for first, texts in substrings.sliced(self.texts)]
        self.at, self.count, self.owner, anchor = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        self.part = ((anchor.astype(np.uint64) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        self.key = (anchor.astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def runs(self, first: int, n: int):
        a = int(self.starts[first])
        z = int(self.starts[first + n - 1] + self.sizes[first + n - 1])
        buf, width = self.buf[a:z], self.size - self.gram + 1
        none = np.zeros(0, np.int64)
        if len(buf) < self.size:
            return none, none, none, none.astype(np.uint64)
        grams = base.Rolling(base.BYTE_VALUES[0][buf]).windows(self.gram)
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        have = 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        each = np.maximum(self.sizes[first : first + n] - self.size + 1, 0)
        owner = np.repeat(np.arange(first, first + n), each)
        window = np.arange(len(owner)) + np.repeat(self.starts[first : first + n] - a - np.r_[0, np.cumsum(each)[:-1]], each)
        anchor = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(owner), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        return window[heads] + a, np.diff(np.r_[heads, len(owner)]), owner[heads], base.mix64(grams[anchor[heads]], 3)

    def anchors(self):
        """Distinct anchors in the order they are sent in: part, key, whether a block has two, and each run's anchor."""
        order = np.lexsort((self.key, self.part))
        p, k = self.part[order], self.key[order]
        new = np.ones(len(order), bool)
        new[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
        heads = np.flatnonzero(new)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return p[heads], k[heads], np.diff(np.r_[heads, len(order)]) > 1, group

    def contents(self, got: dict):
        """Runs whose anchor repeats; their distinct contents in the order they are sent in: part, a run that has it, least doc_id, and each run's content."""
        part, _, twice, group = self.anchors()
        good = twice.copy()
        for p, (where,) in substrings.by_part(part, np.arange(len(part))):
            if (bits := got.get((0, p))) is not None:
                good[where] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(where)).astype(bool)
        runs = np.flatnonzero(good[group])
        ends = self.at[runs] + self.count[runs] + self.size - 1
        hashes = base.Rolling(base.BYTE_VALUES[0][self.buf]).hashes(self.at[runs], ends)
        same, first = equal_runs(self.buf, self.at[runs], ends - self.at[runs], hashes)
        low = np.full(len(first), substrings.NO_ID)
        np.minimum.at(low, same, self.ids[self.owner[runs]])
        order = np.argsort(self.part[runs[first]], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes = hashes[first[order]]
        return runs, place[same], self.part[runs[first[order]]], runs[first[order]], low[order]


def empty() -> pa.Schema:
    return pa.schema([("level", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("lens", pa.binary()), ("text", pa.binary()), ("least", pa.binary()), ("hash", pa.binary())])


def anchor_sender(size: int, parts: int) -> Callable:
    def f(t: pa.Table) -> pa.Table:
        block = Block(t, size, parts)
        part, key, _, _ = block.anchors()
        rows = [{"level": 0, "part": p, "block": t["block"][0].as_py(), "a": k.tobytes()} for p, (k,) in substrings.by_part(part, key)]
        return pa.Table.from_pylist(rows, schema=empty())

    return f


def run_sender(size: int, parts: int) -> Callable:
    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        if not len(t):
            return empty().empty_table()
        block = Block(t, size, parts)
        _, _, part, run, least = block.contents(substrings.replies_of(r))
        rows = []
        for p, (own, low, hashes) in substrings.by_part(part, run, least, block.hashes):
            lens = block.count[own] + size - 1
            at = np.repeat(block.at[own] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
            rows.append({"level": 1, "part": p, "block": t["block"][0].as_py(), "a": block.key[own].tobytes(), "lens": lens.astype(np.uint32).tobytes(), "text": block.buf[at].tobytes(), "least": low.tobytes(), "hash": hashes.tobytes()})
        return pa.Table.from_pylist(rows, schema=empty())

    return f


def equal_runs(buf: np.ndarray, begin: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each run of equal bytes, and the first run of each class. Hashes propose, bytes decide."""
    order = np.lexsort((hashes, lens))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(lens[order]) != 0)
    head = np.empty(len(order), np.int64)
    head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    for at in range(0, len(order), 1 << 14):
        some = np.arange(at, min(at + (1 << 14), len(order)))
        own = lens[some]
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        differs = buf[np.repeat(begin[some], own) + inside] != buf[np.repeat(begin[head[some]], own) + inside]
        wrong = some[np.add.reduceat(differs, np.cumsum(own) - own) > 0]
        head[wrong] = wrong
    first, same = np.unique(head, return_inverse=True)
    return same, first


def suffix_sorter(size: int) -> Callable:
    def f(t: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint32) for x in t["lens"].to_pylist()]
        lens = np.concatenate(sent).astype(np.int64)
        key = np.frombuffer(b"".join(t["a"].to_pylist()), np.uint32)
        least = np.frombuffer(b"".join(t["least"].to_pylist()), np.int64)
        buf = np.frombuffer(b"".join(t["text"].to_pylist()), np.uint8)
        begin = np.cumsum(lens) - lens
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(times[which] > 1)
        mask = np.zeros(len(lens), np.uint64)
        if len(kept):
            same, first = equal_runs(buf, begin[kept], lens[kept], np.frombuffer(b"".join(t["hash"].to_pylist()), np.uint64)[kept])
            low = np.full(len(first), substrings.NO_ID)
            np.minimum.at(low, same, least[kept])
            each = lens[kept[first]] - size + 1
            place = np.cumsum(each) - each
            run = np.repeat(np.arange(len(first)), each)
            order, new = deep_shallow(buf, begin[kept[first]][run] + np.arange(len(run)) - place[run], size)
            heads = np.flatnonzero(new)
            earliest = np.empty(len(run), np.int64)
            earliest[order] = np.repeat(np.minimum.reduceat(low[run[order]], heads), np.diff(np.r_[heads, len(order)]))
            for j in range(int(each.max())):
                some = each[same] > j
                hit = earliest[np.where(some, place[same] + j, 0)] < least[kept]
                mask[kept[some & hit]] |= np.uint64(1) << np.uint64(j)
        bits = [x.tobytes() for x in np.split(mask, np.cumsum([len(x) for x in sent])[:-1])]
        return pa.table({"level": t["level"], "part": t["part"], "block": t["block"], "bits": pa.array(bits, pa.binary())})

    return f


def finisher(size: int, parts: int) -> Callable:
    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
        if not len(t):
            return schema.empty_table()
        got = substrings.replies_of(r)
        block = Block(t, size, parts)
        runs, content, part, _, least = block.contents(got)
        mask = np.zeros(len(part), np.uint64)
        for p, (where,) in substrings.by_part(part, np.arange(len(part))):
            if (bits := got.get((1, p))) is not None:
                mask[where] = np.frombuffer(bits, np.uint64)
        own = np.where(block.ids[block.owner[runs]] > least[content], np.uint64((1 << 64) - 1), mask[content])
        step = np.zeros(len(block.buf) + 1, np.int32)
        for j in range(int(block.count[runs].max(initial=0))):
            hit = block.at[runs[(block.count[runs] > j) & ((own >> np.uint64(j)) & np.uint64(1)).astype(bool)]] + j
            np.add.at(step, hit, 1)
            np.add.at(step, hit + size, -1)
        cover = np.cumsum(step[:-1], dtype=np.int32) > 0
        removed, spans, kept = [], [], []
        for text, a, n in zip(block.texts, block.starts.tolist(), block.sizes.tolist(), strict=True):
            gone = cover[a : a + n]
            removed.append(int(np.count_nonzero(gone)))
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist() if removed[-1] else []
            spans.append([{"start": x, "end": y} for x, y in zip(edges[0::2], edges[1::2], strict=True)])
            kept.append(block.buf[a : a + n][~gone].tobytes() if removed[-1] else text)
        return pa.table([block.doc_ids.combine_chunks(), pa.array(block.sizes), pa.array(removed, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary())], schema=schema)

    return f


def repeated_bytes(docs: DataFrame, size: int = 50) -> DataFrame:
    """For each document: n_bytes, n_removed, the removed runs of bytes (spans) and the kept bytes.

    A byte goes if a string of `size` bytes over it also starts in a document with a smaller doc_id. size: 8 to 89.
    """
    if not 8 <= size < GRAM + 64:
        raise ValueError("size: 8 to 89")
    docs = docs.select("doc_id", "text")
    parts = base.parts_for(docs, 2 << 20)
    grouped = base.blocks(docs, "bytes", 3 << 20).groupBy("block")
    sent = grouped.applyInArrow(anchor_sender(size, parts), MESSAGE)
    first = base.written(sent.repartition(parts, "part").groupBy("part").applyInArrow(substrings.answers(False), substrings.REPLY), "anchors")
    sent = grouped.cogroup(first.groupBy("block")).applyInArrow(run_sender(size, parts), MESSAGE)
    second = base.written(sent.repartition(parts, "part").groupBy("part").applyInArrow(suffix_sorter(size), substrings.REPLY), "suffixes")
    return grouped.cogroup(first.unionByName(second).groupBy("block")).applyInArrow(finisher(size, parts), RESULT)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(base.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
