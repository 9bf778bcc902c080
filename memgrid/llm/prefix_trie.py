"""Prefix trie of conversations by whole-sequence collapse.

Conversations are rebuilt, identical ones become one weighted sequence with the list of conversations that end there, sequences that are
proper prefixes are dropped by an anti-join to find the leaves, and the prefixes of the sequences are aggregated with their weights.

A prefix is known by 128 bits: the xor of a hash of (place, role, text) over its turns. A turn's role and text are digested where they
lie, so texts never move. All sums along a conversation go by blocks of BLOCK turns: windows inside a block, and one row for each
block above; joins on a conversation carry the block in their key. No group is larger than a block times a constant, but that of equal
prefixes, which is added up before it moves. Each prefix belongs to the least conversation that has it, so that what a conversation
owns is the tail of its path, and a subtree's sum is that of all conversations through it less what their owner has above.

Defined results: turns stand in the order of `turn`, null first; turns with equal numbers (repeated rows too) are turns of their own,
in the order of a hash of role and text; rows without conv_id belong to no conversation; a null role or text is an empty one; the
column names are fixed and other columns are ignored; an empty table gives an empty one, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base

#: The remainder of a conversation's number to this leads to the conversation whose start it takes.
FAMILY = 5
#: How many turns at most a conversation takes over.
MOST_TAKEN = 8
#: Turns that are summed up in one window.
BLOCK = 4096
#: Bytes of a piece of an end list.
PIECE = 1 << 18
#: A parent with more than this part of all nodes as children is looked up in a broadcast table, of so many rows at most.
HEAVY = 10_000


def taken(conv: Column) -> Column:
    """How many turns of the family's first conversation a conversation starts with."""
    return (F.crc32(conv.cast("string").cast("binary")) % (MOST_TAKEN + 1)).cast("int")


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, xa, xb, bytes): 120 bits of a digest of role and text, and the text's UTF-8 bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    half = lambda at: F.conv(F.substring("hex", at, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256).alias("hex"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.select("conv_id", "turn", half(1).alias("xa"), half(16).alias("xb"), "bytes")


def placed(rows: DataFrame) -> DataFrame:
    """rows with `idx`, a turn's place from 1 in its conversation.

    Rows are dealt out in ranges of (conv_id, turn, digest, place in the table), so a long conversation and equal rows spread over many
    tasks. Each task numbers what it has of a conversation; what stands in the ranges before is added, known from a row a range.
    """
    spark = rows.sparkSession
    order = ["conv_id", F.col("turn").asc_nulls_first(), "xa", "xb", "spread"]
    parts = base.parts_for(rows, 64 << 20)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, had = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b.column("conv_id").to_numpy()
            if not len(conv):
                continue
            new = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            own = np.arange(1, len(conv) + 1) - np.repeat(new, np.diff(np.r_[new, len(conv)]))
            if conv[0] == last:
                own[: new[1] if len(new) > 1 else len(own)] += had
            last, had = conv[-1], int(own[-1])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("conv_id", "xa", "xb", "bytes")] + [pa.array(np.full(len(own), part, np.int32)), pa.array(own.astype(np.int64))], ["conv_id", "xa", "xb", "bytes", "part", "own"])

    dealt = rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = base.written(dealt.mapInArrow(numbered, "conv_id long, xa long, xb long, bytes long, part int, own long"), "turns")
    # a row a range: what the last conversation has up to there, and whether the next range goes on with it
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "own")).alias("last"))
    sums = ends.select("part", "first", F.col("last.conv_id").alias("last"), F.sum("last.own").over(W.partitionBy("last.conv_id").orderBy("part")).alias("had"))
    earlier = W.orderBy("part")
    carry = sums.select("part", F.col("first").alias("conv_id"), F.lag("last").over(earlier).alias("last"), F.lag("had").over(earlier).alias("before")).where("conv_id = last").drop("last")
    return local.join(F.broadcast(carry), ["part", "conv_id"], "left").select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("idx"), "xa", "xb", "bytes")


def at_place(xa: Column, xb: Column, place: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at a place."""
    return F.xxhash64(xa, xb, place), F.xxhash64(place, xb, xa)


def block(place: Column | str) -> Column:
    return F.floor((F.col(place) if isinstance(place, str) else place) / BLOCK).cast("long")


def families(turns: DataFrame) -> DataFrame:
    """(conv_id, n, h, m, head) of each conversation: its turns, how many it should take over and does, and those as an array of (xa, xb, bytes).

    The first conversation of a family takes over nothing: its rebuilt form is its own.
    """
    counted = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("idx") <= MOST_TAKEN))
    first = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "xa", "xb", "bytes"))).alias("start")).select(F.col("conv_id").alias("root"), "start")
    rows = counted.withColumn("root", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "root", "left")
    own = F.col("root") == F.col("conv_id")
    h = F.when(own, 0).otherwise(taken(F.col("conv_id")))
    none = F.array().cast("array<struct<idx:bigint,xa:bigint,xb:bigint,bytes:bigint>>")
    rows = rows.select("conv_id", "n", h.alias("h"), F.coalesce("start", none).alias("start"))
    head = F.when(F.col("h") > 0, F.slice("start", F.lit(1), F.col("h"))).otherwise(none)
    return rows.select("conv_id", "n", "h", head.alias("head")).withColumn("m", F.size("head"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, block, ka, kb, pa, pb, bytes): each turn of each rebuilt conversation, and (0, 0, ...) for its start.

    ka and kb are the prefix up to and with the turn, pa and pb that before it.
    """
    info = base.written(families(turns), "families")
    tail = turns.withColumn("block", block("idx")).join(_spread(info.select("conv_id", "n", "h", "m"), F.col("n")).drop("n"), ["conv_id", "block"])
    tail = tail.where("idx > h").withColumn("depth", F.col("idx") - F.col("h") + F.col("m"))
    va, vb = at_place(F.col("xa"), F.col("xb"), F.col("depth"))
    tail = base.written(tail.select("conv_id", "block", "depth", "bytes", va.alias("va"), vb.alias("vb")), "tails")

    def started(acc: Column, x: Column) -> Column:
        """The prefixes of an array of turns."""
        last = F.get(acc, F.size(acc) - 1)
        a, b = at_place(x["xa"], x["xb"], x["idx"])
        row = F.struct(x["idx"].alias("depth"), x["bytes"].alias("bytes"), last["ka"].bitwiseXOR(a).alias("ka"), last["kb"].bitwiseXOR(b).alias("kb"), last["ka"].alias("pa"), last["kb"].alias("pb"))
        return F.concat(acc, F.array(row))

    zero = F.lit(0).cast("long")
    root = F.array(F.struct(zero.alias("depth"), zero.alias("bytes"), zero.alias("ka"), zero.alias("kb"), zero.alias("pa"), zero.alias("pb")))
    heads = info.select("conv_id", F.aggregate("head", root, started).alias("rows"))
    sums = tail.groupBy("conv_id", "block").agg(F.bit_xor("va").alias("sa"), F.bit_xor("vb").alias("sb"))
    last = F.get("rows", F.size("rows") - 1)
    carry = sums.join(heads.select("conv_id", last["ka"].alias("ha"), last["kb"].alias("hb")), "conv_id")
    above = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    up = lambda h, s: F.col(h).bitwiseXOR(F.coalesce(F.bit_xor(s).over(above), F.lit(0)))
    carry = carry.select("conv_id", "block", up("ha", "sa").alias("ca"), up("hb", "sb").alias("cb"))
    within = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    ka, kb = F.col("ca").bitwiseXOR(F.bit_xor("va").over(within)), F.col("cb").bitwiseXOR(F.bit_xor("vb").over(within))
    tail = tail.join(carry, ["conv_id", "block"]).select("conv_id", "depth", "bytes", ka.alias("ka"), kb.alias("kb"), "va", "vb")
    tail = tail.select("conv_id", "depth", "bytes", "ka", "kb", F.col("ka").bitwiseXOR(F.col("va")).alias("pa"), F.col("kb").bitwiseXOR(F.col("vb")).alias("pb"))
    heads = heads.select("conv_id", F.inline("rows")).select("conv_id", "depth", "bytes", "ka", "kb", "pa", "pb")
    return heads.unionByName(tail).withColumn("block", block("depth"))


def _spread(rows: DataFrame, most: Column) -> DataFrame:
    """A row of `rows` for each block of places up to `most`, for joins that carry the block."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block(most))))


def end_digests(ends: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256) of rows (ka, kb, conv_id): SHA-256 of the numbers in ascending order, comma-joined.

    Ranges of (ka, kb, conv_id) make pieces of the text, so a long list is sorted in many tasks; then a list's pieces run through one
    hash in order. Neither holds more than a batch and a piece.
    """
    names = ["ka", "kb", "part", "piece"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held, size, n = TaskContext.get().partitionId(), None, [], 0, 0
        out: list[tuple] = []
        for b in batches:
            for *own, conv in zip(*(b.column(c).to_pylist() for c in ("ka", "kb", "conv_id")), strict=True):
                if own != key or size > PIECE:
                    if held:
                        out.append((*key, part, n, ",".join(held)))
                    key, held, size, n = own, [], 0, n + 1
                held.append(str(conv))
                size += len(held[-1])
            if out:
                yield rows_of(out)
                out = []
        if held:
            yield rows_of([(*key, part, n, ",".join(held))])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*names, "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for b in batches:
            out: list[tuple] = []
            for *own, text in zip(*(b.column(c).to_pylist() for c in ("ka", "kb", "text")), strict=True):
                if own != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["ka", "kb", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["ka", "kb", "ends_sha256"])

    order = ["ka", "kb", "conv_id"]
    cut = ends.repartitionByRange(base.parts_for(ends, 64 << 20), *order).sortWithinPartitions(*order).mapInArrow(pieces, "ka long, kb long, part int, piece long, text string")
    return cut.repartition("ka", "kb").sortWithinPartitions(*names).mapInArrow(hashed, "ka long, kb long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node, as the module says."""
    rows = base.written(rebuilt(base.written(placed(digested(conversations)), "places")), "rebuilt")
    # whole sequences
    last = rows.groupBy("conv_id", "block").agg(F.max_by(F.struct("depth", "ka", "kb"), "depth").alias("end")).groupBy("conv_id").agg(F.max("end").alias("end"))
    ends = base.written(last.select("conv_id", F.col("end.ka").alias("ka"), F.col("end.kb").alias("kb"), F.col("end.depth").alias("length")), "ends")
    sequences = base.written(ends.groupBy("ka", "kb").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("weight"), F.first("length").alias("length")), "sequences")
    # prefixes of one conversation for each sequence, with its weight
    weights = _spread(sequences.select(F.col("owner").alias("conv_id"), "weight", "length"), F.col("length"))
    paths = base.written(rows.join(weights, ["conv_id", "block"]), "paths")
    nodes = paths.groupBy("ka", "kb").agg(
        F.min("conv_id").alias("owner"), F.sum("weight").alias("n_convs"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"),
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.max(F.col("depth") < F.col("length")).alias("goes_on"),
    )
    nodes = base.written(nodes.withColumn("cost", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("block", block("depth")), "nodes")
    leaves = sequences.join(nodes.where("goes_on").select("ka", "kb"), ["ka", "kb"], "left_anti").select(F.col("owner").alias("conv_id"), F.lit(1).alias("leaf"))
    # what each sequence owns, and from which depth on
    blocks = base.written(nodes.groupBy("owner", "block").agg(F.sum("cost").alias("cost"), F.min("depth").alias("from_depth")), "owned")
    owned = blocks.groupBy("owner").agg(F.sum("cost").alias("cost"), F.min("from_depth").alias("from_depth")).withColumnRenamed("owner", "conv_id")
    of_path = sequences.select(F.col("owner").alias("conv_id"), "length").join(leaves, "conv_id", "left").join(owned, "conv_id", "left")
    of_path = of_path.select("conv_id", "length", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("from_depth", F.col("length") + 1).alias("from_depth"))
    through = paths.select("conv_id", "block", "depth", "ka", "kb").join(_spread(of_path, F.col("length")), ["conv_id", "block"])
    child = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("from_depth"))
    through = through.groupBy("ka", "kb").agg(F.sum("leaf").alias("n_leaves"), F.sum("cost").alias("all_cost"), F.sum(child.cast("long")).alias("n_children"))
    # less what the owner has above
    earlier = W.partitionBy("owner").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = blocks.select("owner", "block", "from_depth", F.coalesce(F.sum("cost").over(earlier), F.lit(0)).alias("start"), (F.min("from_depth").over(W.partitionBy("owner"))).alias("top"))
    inside = W.partitionBy("owner", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    nodes = nodes.join(start.drop("from_depth"), ["owner", "block"]).withColumn("above", F.col("start") + F.coalesce(F.sum("cost").over(inside), F.lit(0)))
    nodes = base.written(nodes.join(through, ["ka", "kb"]).join(end_digests(ends), ["ka", "kb"], "left"), "counted")
    # parents: the owner itself, but at the top of what it owns
    tops = nodes.where("depth = top and depth > 0").select("ka", "kb", "pa", "pb")
    parents = nodes.where("n_children > 0").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("owner").alias("parent"), "n_children")
    heavy = F.col("n_children") * HEAVY > nodes.count()  # so there are HEAVY of them at most
    many = parents.where(heavy).drop("n_children")
    by_many = tops.join(F.broadcast(many), ["pa", "pb"], "left")
    found = by_many.where("parent is not null").select("ka", "kb", "parent").unionByName(
        by_many.where("parent is null").drop("parent").join(parents.where(~heavy).drop("n_children"), ["pa", "pb"]).select("ka", "kb", "parent")
    )
    nodes = nodes.join(found, ["ka", "kb"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "owner"))
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return nodes.select(F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("all_cost") - F.col("above")).alias("saved_tokens"), digest.alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = "list_reduce([4294967295::bigint] || list_transform(range(1, length(c) + 1), lambda i: ascii(c[i])::bigint), lambda x, y: list_reduce([xor(x, y)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))))"
ORACLE_SQL = f"""
with c as (select conv_id, conv_id::varchar c, list({{'r': coalesce(role, ''), 't': coalesce("text", '')}} order by turn nulls first, role, "text") ts from conversations where conv_id is not null group by conv_id),
h as (select conv_id, ts, xor({_CRC}, 4294967295) % {MOST_TAKEN + 1} h from c),
r as (select h.conv_id, list_concat(coalesce(b.ts[1:h], []), h.ts[h + 1:]) s from h left join c b on b.conv_id = h.conv_id - h.conv_id % {FAMILY}),
p as (select conv_id, s, unnest(range(0, len(s) + 1)) depth from r),
n as (select s[1:depth] k, depth, min(conv_id) conv_id, count(*) n_convs from p group by all),
u as (select s k, string_agg(conv_id::varchar, ',' order by conv_id) ids from r group by s),
x as (select k, depth, case when depth = 0 then 0 else (n_convs - 1) * octet_length(encode(k[depth].t)) end cost, depth > 0 inner_node from n),
kids as (select k[1:depth - 1] k, count(*) n_children from n where depth > 0 group by all),
leaf as (select x.k, x.cost, x.depth, kids.k is null leaf from x left join kids on kids.k = x.k),
sub as (select k[1:d] k, sum(cost) saved, count(*) filter (leaf) n_leaves from (select k, cost, leaf, unnest(range(0, depth + 1)) d from leaf) group by all)
select n.conv_id, n.depth, q.conv_id parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) n_children, sub.n_leaves, sub.saved::bigint saved_tokens, sha256(coalesce(u.ids, '')) ends_sha256
from n join sub on sub.k = n.k left join kids on kids.k = n.k left join u on u.k = n.k left join n q on n.depth > 0 and q.k = n.k[1:n.depth - 1]
"""
