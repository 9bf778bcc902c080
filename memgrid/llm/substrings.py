"""Substring dedup over words by level-wise doubling.

Short windows are looked at first. Those whose content occurs twice in the corpus are candidates; only where candidates cover a window
of twice their length (at the last level: of the wanted length, if that is less) is it looked at again, at that length. Levels end when
no candidate survives, or at the wanted length, where what survives is a repeat.

Texts stay in one table bucketed by block. What moves between tasks at a level is each block's set of distinct window hashes (four
bytes each below the last level, 16 and the least doc_id at the last), split over parts by hash, and one bit back for each. So a
window that a third of all documents share is sent once a block. A block also sends itself which windows it looked at, so that later
levels start from there. The first levels' short hashes only choose candidates; a false one
is dropped at the next level. The last level takes windows with equal 128-bit hashes of their words as equal: sending the words would
move each repeated word 13 times.

Defined results: a null text is an empty one; an empty text, or one shorter than a window, loses nothing; a null doc_id counts as
larger than any other; rows that share a doc_id are documents of their own, and neither removes words of the other; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

NO_ID = np.iinfo(np.int64).max
MESSAGE = "level int, part int, block long, a binary, b binary, least binary"
REPLY = "level int, part int, block long, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


#: Words of the windows that are looked at first.
FIRST = 4


def levels(size: int, first: int = FIRST) -> list[int]:
    """Window lengths from `first` on, each twice the one before; the last is `size`."""
    out = [min(first, size)]
    while out[-1] < size:
        out.append(min(2 * out[-1], size))
    return out


def block_docs(t: pa.Table) -> pa.Table:
    return t.sort_by("row")


def ids_of(t: pa.Table) -> np.ndarray:
    return t["doc_id"].fill_null(NO_ID).to_numpy().astype(np.int64)


def by_part(part: np.ndarray, *columns: np.ndarray):
    """(part, slices of columns) for each part; part is sorted."""
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(part)], strict=True):
        if z > a:
            yield int(part[a]), [c[a:z] for c in columns]


class Block:
    """A block's words: hashes, and which windows are candidates so far."""

    def __init__(self, t: pa.Table, sizes: list[int], parts: int):
        t = block_docs(t)
        self.ids, self.sizes, self.parts = ids_of(t), sizes, parts
        self.number = t["block"][0].as_py()
        self.doc_ids = t["doc_id"]
        self.texts = base.byte_list(t["text"].combine_chunks())
        self.counts = np.zeros(len(self.texts), np.int64)
        hashes, owner = ([], []), []
        for first, texts in sliced(self.texts):
            buf, starts, _ = base.joined(texts)
            a, z = base.word_bounds(buf)
            doc = base.doc_of(a, starts)
            self.counts[first : first + len(texts)] = np.bincount(doc, minlength=len(texts))
            owner.append((doc + first).astype(np.int32))
            for k in (0, 1):
                hashes[k].append(base.word_hashes(buf, a, z, k))
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        self.words = [base.Rolling(np.concatenate(h), k) if len(self.owner) else None for k, h in enumerate(hashes)]

    def fits(self, size: int) -> np.ndarray:
        """Starts of the windows that lie within one document."""
        n = len(self.owner) - size + 1
        return np.flatnonzero(self.owner[:n] == self.owner[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def sent(self, level: int, replies: dict) -> tuple:
        """Windows looked at on a level; their distinct contents in the order they are sent in; each content's least doc_id and whether two documents here have it."""
        size = self.sizes[level]
        seen = replies.get((level, own_part(self.number, self.parts)))
        if seen is not None:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(seen, np.uint8), count=len(self.owner)))
        else:
            at = self.fits(size) if level == 0 else self.extended(level, replies)
        last = level == len(self.sizes) - 1
        a = self.words[0].windows(size)[at] if len(at) else np.zeros(0, np.uint64)
        b = self.words[1].windows(size)[at] if last and len(at) else a
        part = (a >> np.uint64(32)) % np.uint64(self.parts)
        if not last:
            a = b = a & np.uint64(0xFFFFFFFF)
        doc = self.ids[self.owner[at]]
        order = np.lexsort((b, a, part)) if last else np.argsort((part << np.uint64(32)) | a, kind="stable")
        new = np.ones(len(at), bool)
        p, x, y = part[order], a[order], b[order]
        new[1:] = (p[1:] != p[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        heads = np.flatnonzero(new)
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc[order], heads) if len(heads) else doc
        copies = np.diff(np.r_[heads, len(at)]) > 1
        return at, group, p[heads].astype(np.int32), x[heads], y[heads], least, copies

    def answered(self, level: int, part: np.ndarray, replies: dict) -> np.ndarray:
        out = np.zeros(len(part), bool)
        for p, (where,) in by_part(part, np.arange(len(part))):
            bits = replies.get((level, p))
            if bits is not None:
                out[where] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(where)).astype(bool)
        return out

    def extended(self, level: int, replies: dict) -> np.ndarray:
        """Windows of this level's length whose two halves, of the length below, both survived."""
        at, group, part, _, _, _, copies = self.sent(level - 1, replies)
        good = (copies | self.answered(level - 1, part, replies))[group]
        alive = np.zeros(len(self.owner), bool)
        alive[at[good]] = True
        size = self.sizes[level]
        starts = self.fits(size)
        return starts[alive[starts] & alive[starts + (size - self.sizes[level - 1])]]


def own_part(block: int, parts: int) -> int:
    """The part by which a block sends to itself."""
    return -1 - block % parts


def sliced(texts: list[bytes]):
    """(number of the first text, texts) in lists of about SLICE_BYTES."""
    first, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > base.SLICE_BYTES:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(x) + 1
    if first < len(texts):
        yield first, texts[first:]


def replies_of(t: pa.Table) -> dict:
    return dict(zip(zip(t["level"].to_pylist(), t["part"].to_pylist(), strict=True), t["bits"].to_pylist(), strict=True))


def sender(level: int, sizes: list[int], parts: int) -> Callable:
    last = level == len(sizes) - 1

    def messages(t: pa.Table, got: dict) -> pa.Table:
        number = t["block"][0].as_py() if len(t) else 0
        rows = []
        if len(t):
            block = Block(t, sizes, parts)
            at, _, part, a, b, least, _ = block.sent(level, got)
            if level and len(at):
                seen = np.zeros(len(block.owner), bool)
                seen[at] = True
                rows.append({"level": level, "part": own_part(number, parts), "block": number, "a": np.packbits(seen).tobytes(), "b": None, "least": None})
            kind = np.uint64 if last else np.uint32
            for p, (x, y, low) in by_part(part, a.astype(kind), b.astype(kind), least):
                rows.append({"level": level, "part": p, "block": number, "a": x.tobytes(), "b": y.tobytes() if last else None, "least": low.tobytes() if last else None})
        return pa.Table.from_pylist(rows, schema=pa.schema([("level", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("least", pa.binary())]))

    if level == 0:
        return lambda t: messages(t, {})
    return lambda t, r: messages(t, replies_of(r))


def answers(last: bool) -> Callable:
    """For each block's contents of one part: on lower levels, whether another block has it; on the last, whether a smaller doc_id has it."""

    def f(t: pa.Table) -> pa.Table:
        if t["part"][0].as_py() < 0:
            return t.select(["level", "part", "block", "a"]).rename_columns(["level", "part", "block", "bits"])
        sizes = [len(x) // (8 if last else 4) for x in t["a"].to_pylist()]
        a = np.frombuffer(b"".join(t["a"].to_pylist()), np.uint64 if last else np.uint32)
        if last:
            b = np.frombuffer(b"".join(t["b"].to_pylist()), np.uint64)
            low = np.frombuffer(b"".join(t["least"].to_pylist()), np.int64)
            order = np.lexsort((b, a))
            new = np.ones(len(a), bool)
            new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        else:
            order = np.argsort(a, kind="stable")
            new = np.ones(len(a), bool)
            new[1:] = np.diff(a[order]) != 0
        heads = np.flatnonzero(new)
        bit = np.empty(len(a), bool)
        each = np.diff(np.r_[heads, len(a)])
        bit[order] = (np.repeat(np.minimum.reduceat(low[order], heads), each) < low[order]) if last else np.repeat(each > 1, each)
        cuts = np.cumsum(sizes)[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(bit, cuts)]
        return pa.table({"level": t["level"], "part": t["part"], "block": t["block"], "bits": pa.array(bits, pa.binary())})

    return f


def finisher(sizes: list[int], parts: int) -> Callable:
    level = len(sizes) - 1

    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
        if not len(t):
            return schema.empty_table()
        got = replies_of(r)
        block = Block(t, sizes, parts)
        at, group, part, _, _, least, _ = block.sent(level, got)
        gone = (block.ids[block.owner[at]] > least[group]) | block.answered(level, part, got)[group]
        step = np.zeros(len(block.owner) + 1, np.int64)
        np.add.at(step, at[gone], 1)
        np.add.at(step, at[gone] + sizes[level], -1)
        cover = np.cumsum(step[:-1]) > 0
        ends = np.cumsum(block.counts)
        removed, spans, kept = [], [], []
        for text, first, end in zip(block.texts, ends - block.counts, ends, strict=True):
            own = cover[first:end]
            words = text.split()
            removed.append(int(own.sum()))
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) if removed[-1] else ()
            spans.append([{"start": int(a), "end": int(z)} for a, z in zip(edges[0::2], edges[1::2], strict=True)])
            kept.append(b" ".join(itertools.compress(words, (~own).tolist()) if removed[-1] else words).decode("utf-8", "replace"))
        return pa.table([block.doc_ids.combine_chunks(), pa.array(block.counts), pa.array(removed, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.string())], schema=schema)

    return f


def repeated_words(docs: DataFrame, size: int = 13, first: int = FIRST) -> DataFrame:
    """For each document: n_words, n_removed, the removed runs of words (spans) and the kept words joined by one space.

    A word goes if a window of `size` words over it also starts in a document with a smaller doc_id. first: words of the first level.
    """
    sizes = levels(size, first)
    docs = docs.select("doc_id", "text")
    parts = base.parts_for(docs, 4 << 20)
    table = base.blocks(docs, "words")
    grouped = table.groupBy("block")
    replies = None
    for level in range(len(sizes)):
        send = sender(level, sizes, parts)
        sent = grouped.applyInArrow(send, MESSAGE) if replies is None else grouped.cogroup(replies.groupBy("block")).applyInArrow(send, MESSAGE)
        answer = sent.repartition(parts, "part").groupBy("part").applyInArrow(answers(level == len(sizes) - 1), REPLY)
        answer = base.written(answer, "replies")
        replies = answer if replies is None else replies.unionByName(answer)
        if answer.isEmpty():  # no candidate survives
            break
    return grouped.cogroup(replies.groupBy("block")).applyInArrow(finisher(sizes, parts), RESULT)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_words(base.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
