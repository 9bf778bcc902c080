"""Language-model scoring by Brown class-based bigrams.

p(w | v) = p(class of w | class of v) * p(w | class of w). Every training word has a class of its own choosing:
1. Exchange clustering of the CLASS_WORDS most frequent words, with all others as one more item and the text's end: each word is moved in
   turn to the class that raises the likelihood of the corpus most, until none moves or a whole round raises the logarithm of the
   likelihood by less than its LEAST part. It works on item pairs counted over the whole corpus, of which there are at most
   (CLASS_WORDS + 2)^2. The number of classes grows with the vocabulary (its cube root).
2. Each remaining word joins the class that raises the likelihood most, given the classes of the words before and after it in the whole
   corpus. These counts are aggregated by Spark, word by word.
3. Transitions between classes are then counted over the whole corpus with every word's class.
Emission uses each word's own count, with one unseen word a class; an unknown token counts as the unseen word of the class that holds
most words seen once.

Texts are cut into words once. A block of documents becomes its distinct words and, for each document, its words' places among them. The
lexicon stays a table, which grows with the corpus: each block sends a word once, with its neighbours there, to where the word's class is
chosen, and its count and class come back to the same place. All that follows works on numbers.

Defined results: a null or empty text is its end alone; a null doc_id is hashed as an empty string; without training rows every token
is unknown, N and V are 0 and both scores 0; repeated rows are documents of their own; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .language_id import remainder

#: Words that are clustered by exchange; all others choose a class afterwards.
CLASS_WORDS = 2046
#: Items of the clustering that are no words: the text's end, and all words that aren't clustered.
END, REST = 0, 1
#: Bytes of text in a block, unless one text alone is longer.
BLOCK_BYTES = 12 << 20
#: Bytes that stand for a text's end between its words' places, which are numbers of four bytes; as a number, -1.
STOP = b"\xff" * 4
#: What a move must gain, as a share of what it compares: rounding aside, none that raises the likelihood is left out.
ROUNDING = 1e-12
#: The part of the likelihood's logarithm that a round of the exchange must gain for another one.
LEAST = 1e-5


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's words start, and where the last one's end; all words in order, as places among the distinct ones."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    starts, found = lists.offsets.to_numpy(), lists.values
    real = pc.greater(pc.binary_length(found), 0)  # a text without words is split into one empty string
    if pc.any(pc.invert(real)).as_py():
        starts = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][starts]
        found = found.filter(real)
    return starts, found.dictionary_encode()


def blobs(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in data; ends: where each starts, and where the last one ends, counted in numbers."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def joined(col: pa.Array | pa.ChunkedArray, kind: type, stop: bytes) -> np.ndarray:
    """The numbers of all binary values of a column, with the end's number after each."""
    return np.frombuffer(stop.join([*col.to_pylist(), b""]), kind)


def coded(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, learn) in blocks, as a table bucketed by block.

    A document is (block, doc_id, learn, places), the places of its words among the block's distinct words. A distinct word is (block, word,
    place, n), n its count in the documents that are learned from. A block holds documents of one input split.
    """
    limit = BLOCK_BYTES

    def rows(block: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        learn = t["learn"].to_numpy()
        starts, words = words_of(t["text"].combine_chunks())
        places = words.indices.to_numpy()
        seen = np.bincount(places[np.repeat(learn, np.diff(starts))], minlength=len(words.dictionary))

        def out(many: int, **columns: pa.Array) -> pa.RecordBatch:
            columns["block"] = pa.array(np.full(many, block))
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(many, f.type) for f in fields], schema=fields)

        yield out(len(t), doc_id=t["doc_id"].combine_chunks(), learn=t["learn"].combine_chunks(), places=blobs(starts.astype(np.int64), places))
        for a in range(0, len(seen), 1 << 16):
            own = seen[a : a + (1 << 16)]
            yield out(len(own), word=words.dictionary.slice(a, len(own)).cast(pa.string()), place=pa.array(np.arange(a, a + len(own), dtype=np.int32)), n=pa.array(own))

    fields = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("places", pa.binary()), ("word", pa.string()), ("place", pa.int32()), ("n", pa.int64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for b in base.slices(batches):
            parts.append(b)
            size += base.field(b, "text").nbytes
            if size >= limit:
                yield from rows(block, parts)
                block, parts, size = block + 1, [], 0
        if parts:
            yield from rows(block, parts)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("learn", F.lit(False)).alias("learn"))
    buckets = max(8, min(1 << 16, -(-base.estimated_bytes(docs) // (4 << 20))))
    return base.bucketed(docs.mapInArrow(f, "block long, doc_id long, learn boolean, places binary, word string, place int, n long"), "block", buckets, "coded")


def learned(t: pa.Table) -> np.ndarray:
    """The places of all words of a block's documents that are learned from; before the first, between them and after the last stands -1."""
    return np.r_[np.int32(-1), joined(t["places"].filter(pc.fill_null(t["learn"], False)), np.int32, STOP)]


def pair_counts(table: DataFrame, top: DataFrame, size: int) -> np.ndarray:
    """How often item follows item in the documents that are learned from; before a text's first word stands an end. top: (block, place, item)."""
    group = 32

    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        line = learned(t)
        own = np.full(int(line.max(initial=-1)) + 2, REST, np.int32)
        at, item = r["place"].to_numpy(), r["item"].to_numpy()
        own[at[at < len(own) - 1]] = item[at < len(own) - 1]
        own[-1] = END
        line = own[line]
        total = np.bincount(line[:-1] * np.int32(size) + line[1:], minlength=size * size)
        code = np.flatnonzero(total)
        left = code // size
        cuts = np.flatnonzero(np.diff(left)) + 1
        right = [x.astype(np.uint16).tobytes() for x in np.split(code % size, cuts)] if len(code) else []
        count = [x.astype(np.uint32).tobytes() for x in np.split(total[code], cuts)] if len(code) else []
        left = left[np.r_[0, cuts]] if len(code) else left
        return pa.table([pa.array((left // group).astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right, pa.binary()), pa.array(count, pa.binary())], names=["part", "item", "next", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros((group, size), np.int64)
        for item, right, n in zip(t["item"].to_pylist(), t["next"].to_pylist(), t["n"].to_pylist(), strict=True):
            total[item % group, np.frombuffer(right, np.uint16)] += np.frombuffer(n, np.uint32)
        at = np.flatnonzero(total.any(axis=1))
        first = t["part"][0].as_py() * group
        return pa.table({"item": pa.array((at + first).astype(np.int32)), "next": pa.array([np.flatnonzero(total[i]).astype(np.uint16).tobytes() for i in at], pa.binary()), "n": pa.array([total[i][total[i] > 0].tobytes() for i in at], pa.binary())})

    docs = table.where("places is not null").select("block", "learn", "places")
    found = docs.groupBy("block").cogroup(top.groupBy("block")).applyInArrow(f, "part int, item int, next binary, n binary")
    out = np.zeros((size, size), np.int64)
    for r in found.groupBy("part").applyInArrow(add, "item int, next binary, n binary").toLocalIterator():
        out[r["item"], np.frombuffer(r["next"], np.uint16)] = np.frombuffer(r["n"], np.int64)
    return out


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchanged(pairs: np.ndarray, classes: int, fixed: int = 0, least: float = 0.0) -> np.ndarray:
    """The class of each item: exchange clustering for the likelihood of the class bigrams, until no item moves.

    least: a round that gains no more than this part of the log likelihood is the last.

    The first `fixed` items keep classes of their own, after the others' (numbers from `classes` on).
    """
    weight = pairs.sum(axis=0)
    order = np.argsort(-weight, kind="stable")
    order = order[order >= fixed]
    label = np.empty(len(pairs), np.int64)
    label[order] = np.arange(len(order)) % classes
    label[:fixed] = classes + np.arange(fixed)
    order = order[weight[order] > 0]
    back = np.ascontiguousarray(pairs.T)
    every = classes + fixed
    one = np.eye(every)[label]
    table = one.T @ (pairs.astype(np.float64) @ one)
    k = np.arange(every)
    f = xlogx(table)

    def changed(c: int) -> None:
        f[c], f[:, c] = xlogx(table[c]), xlogx(table[:, c])

    # with the words' own counts, which no move changes, this is the log likelihood
    likelihood = lambda: f.sum() - xlogx(table.sum(axis=0)).sum() - xlogx(table.sum(axis=1)).sum() + xlogx(weight.astype(np.float64)).sum()
    moved, reached = 1, likelihood()
    while moved:
        moved = 0
        for i in order.tolist():
            own, self_pair = label[i], float(pairs[i, i])
            out = np.bincount(label, pairs[i], every)
            into = np.bincount(label, back[i], every)
            out[own] -= self_pair
            into[own] -= self_pair
            table[own] -= out
            table[:, own] -= into
            table[own, own] -= self_pair
            changed(own)
            left, right = table.sum(axis=1), table.sum(axis=0)
            both = table[k, k]
            after, before = np.flatnonzero(out), np.flatnonzero(into)  # only these columns and rows change
            gain = (xlogx(table[:, after] + out[after]) - f[:, after]).sum(axis=1) + (xlogx(table[before] + into[before, None]) - f[before]).sum(axis=0)
            gain += xlogx(both + out + into + self_pair) - xlogx(both) - (xlogx(both + out) - xlogx(both)) - (xlogx(both + into) - xlogx(both))
            gain -= xlogx(left + out.sum() + self_pair) - xlogx(left) + xlogx(right + into.sum() + self_pair) - xlogx(right)
            best = int(gain[:classes].argmax())
            if gain[best] <= gain[own] + ROUNDING * f.sum():
                best = own
            moved += best != own
            label[i] = best
            table[best] += out
            table[:, best] += into
            table[best, best] += self_pair
            changed(best)
        before, reached = reached, likelihood()
        if reached - before <= least * abs(before):
            break
    return label


def neighbours(table: DataFrame, top: DataFrame, label: np.ndarray, classes: int) -> DataFrame:
    """(word, block, place, codes) of all distinct words of all blocks: two numbers of two bytes for each occurrence that is learned from, the classes after and before it. None for items of the clustering, which `label` has classes of."""
    held = base.shared(table.sparkSession, label)

    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        line = learned(t)
        t = t.filter(pc.is_valid(t["word"]))
        own = np.full(len(t) + 1, classes + 1, np.int64)
        own[r["place"].to_numpy()] = held()[r["item"].to_numpy()]
        own[-1] = classes
        c = own[line]
        at = np.flatnonzero(c == classes + 1)
        # sorted, so that the result doesn't depend on the order of documents
        found = np.sort(line[at].astype(np.int64) << 32 | c[at - 1] << 16 | c[at + 1])
        ends = np.r_[0, np.cumsum(np.bincount(found >> 32, minlength=len(t)))]
        order = np.argsort(t["place"].to_numpy())
        return pa.table([t["word"].take(pa.array(order)), t["block"], pa.array(np.arange(len(t), dtype=np.int32)), blobs(ends, (found & 0xFFFFFFFF).astype(np.uint32))], names=["word", "block", "place", "codes"])

    rows = table.select("block", "learn", "places", "word", "place")
    return rows.groupBy("block").cogroup(top.groupBy("block")).applyInArrow(f, "word string, block long, place int, codes binary")


def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows (hash, word, ...) in order of hash, cut so that rows of a word stay together and put together where hashes clash; and where each word starts."""
    held = None
    for b in chain(batches, [None]):
        if b is not None:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            h = t["hash"].to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
            t, held = t.slice(0, cut), t.slice(cut)
        else:
            t = held
        if t is None or not len(t):
            continue
        t = t.combine_chunks()
        h = t["hash"].to_numpy()
        new = np.r_[True, h[1:] != h[:-1]]
        other = np.r_[True, pc.not_equal(t["word"][1:], t["word"][:-1]).to_numpy()]
        if (new != other).any():
            t = t.sort_by([("hash", "ascending"), ("word", "ascending")]).combine_chunks()
            other = np.r_[True, pc.not_equal(t["word"][1:], t["word"][:-1]).to_numpy()]
        yield t, np.flatnonzero(other)


def chosen_classes(seen: DataFrame, pairs: np.ndarray, label: np.ndarray, classes: int, items: list[tuple[str, int, int]]) -> DataFrame:
    """(block, place, n, class, word) for each row of seen (word, block, place, codes) whose word was learned; word: only in its first row.

    The class is that which raises the likelihood most; ties go to the lowest. items: (word, n, class) of words that have theirs.
    """
    one = np.eye(classes + 2)[label]
    table = one.T @ (pairs.astype(np.float64) @ one)
    follow = np.log((table + 0.1) / (table.sum(axis=1, keepdims=True) + 0.1 * (classes + 2)))
    mass = np.log(table.sum(axis=0)[:classes] + 1)
    # what one neighbour adds to each class's likelihood: classes after the word, then classes before it
    gains = np.concatenate([follow[:classes].T, follow[:, :classes]])
    held = base.shared(seen.sparkSession, (gains, mass, items))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, mass, items = held()
        known = pa.array([x[0] for x in items], pa.string())
        settled = np.array([x[1:] for x in items], np.int64).reshape(-1, 2)
        width = len(gains)
        for t, first in by_word(batches):
            size = np.r_[first[1:], len(t)] - first
            own = np.repeat(np.arange(len(first)), size)
            col = t["codes"].combine_chunks()
            many = pc.binary_length(col).to_numpy() // 2
            code = np.frombuffer(b"".join(col.to_pylist()), np.uint16).astype(np.int64)
            code[1::2] += width // 2
            at = np.repeat(own, many)
            times = np.bincount(at, minlength=len(first)) // 2
            best = np.zeros(len(first), np.int64)
            # counts of each word's codes, then one product
            for a in range(0, len(first), 1024):
                part = slice(*np.searchsorted(at, (a, a + 1024)))
                n = min(1024, len(first) - a)
                counts = np.bincount((at[part] - a) * width + code[part], minlength=n * width).reshape(n, width)
                best[a : a + n] = (counts @ gains - times[a : a + n, None] * mass).argmax(axis=1)
            words = t["word"].take(pa.array(first)).combine_chunks()
            found = pc.fill_null(pc.index_in(words, known), -1).to_numpy()
            times[found >= 0], best[found >= 0] = settled[found[found >= 0]].T
            is_first = np.zeros(len(t), bool)
            is_first[first] = True
            word = pc.if_else(pa.array(is_first), t["word"].combine_chunks(), pa.scalar(None, pa.string()))
            out = pa.RecordBatch.from_arrays([t["block"].combine_chunks(), t["place"].combine_chunks(), pa.array(times[own]), pa.array(best[own].astype(np.int32)), word], ["block", "place", "n", "class", "word"])
            yield out.filter(pa.array(times[own] > 0))

    rows = seen.select(F.xxhash64("word").alias("hash"), "word", "block", "place", "codes").repartition("hash").sortWithinPartitions("hash")
    return rows.mapInArrow(f, "block long, place int, n long, class int, word string")


def labelled(table: DataFrame, answers: DataFrame, ends: int) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, logs, labels) of all documents of a coded table: the sum of log10(count + 1) and each word's class, -1 if unknown."""

    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        line = joined(t["places"], np.int32, STOP)
        most = int(line.max(initial=-1)) + 1
        label, count = np.full(most + 1, -1, np.int16), np.zeros(most + 1, np.int64)
        label[r["place"].to_numpy()], count[r["place"].to_numpy()] = r["class"].to_numpy(), r["n"].to_numpy()
        count[-1] = ends
        stops = np.flatnonzero(line < 0)
        starts = np.r_[0, stops[:-1] + 1] if len(stops) else stops
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        n_tokens = stops + 1 - starts
        columns = [pa.array(n_tokens), pa.array(add((count > 0).astype(np.int64)[line])), pa.array(add(np.log10(count + 1.0)[line]))]
        labels = blobs(np.r_[0, np.cumsum(n_tokens - 1)], label[line[line >= 0]])
        return pa.table([t["doc_id"], t["learn"], *columns, labels], names=["doc_id", "learn", "n_tokens", "n_known", "logs", "labels"])

    docs = table.where("places is not null").select("block", "doc_id", "learn", "places")
    rows = answers.select("block", "place", "n", "class")
    return docs.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(f, "doc_id long, learn boolean, n_tokens long, n_known long, logs double, labels binary")


def transitions(rows: DataFrame, classes: int) -> np.ndarray:
    """How often class follows class in the rows (labels); the last number is the end."""
    size = classes + 1

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for b in base.slices(batches, "labels"):
            line = np.r_[classes, joined(b["labels"], np.int16, np.int16(classes).tobytes())].astype(np.int64)
            total += np.bincount(line[:-1] * size + line[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    out = np.zeros(size * size, np.int64)
    for r in rows.select("labels").mapInArrow(f, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["code"]] = r["n"]
    return out.reshape(size, size)


class Scorer:
    """What executors need beside the words' classes: transitions, sizes of classes and totals."""

    def __init__(self, follow: np.ndarray, mass: np.ndarray, kinds: np.ndarray, single: np.ndarray, ends: int, total: int, types: int):
        """follow: class after class, the end last; mass, kinds, single: words, different words and words seen once of each class."""
        self.classes = len(mass)
        follow = np.log10((follow + 0.1) / (follow.sum(axis=1, keepdims=True) + 0.1 * len(follow)))
        self.step = follow - np.log10(np.r_[mass + kinds, ends + (ends > 0)] + 1.0)
        self.unseen = int(np.argmax(single)) if len(single) else 0
        self.total = total
        self.floor = float(np.log10(total + types + 1))

    def scores(self, n_tokens: np.ndarray, logs: np.ndarray, labels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """base_score and score of texts by their words' classes and the sums of the logarithms of their counts."""
        if not self.total or not len(logs):
            return np.zeros(len(logs)), np.zeros(len(logs))
        line = joined(labels, np.int16, np.int16(self.classes).tobytes()).astype(np.int64)
        line[line < 0] = self.unseen
        model = self.step[np.r_[self.classes, line[:-1]], line]
        return logs - n_tokens * self.floor, logs + np.add.reduceat(model, np.r_[0, np.cumsum(n_tokens)[:-1]])


def class_count(types: int) -> int:
    """The number of classes for a vocabulary: the cube root of its size."""
    return max(2, round(types ** (1 / 3)))


class Lexicon:
    """Learned from rows (doc_id, text) where `training` holds, by default from all: the table (word, n, class) of all words, and what clustering found.

    table: the rows as coded() has them; answers: (block, place, n, class, word) of the blocks' words that were learned.
    """

    def __init__(self, rows: DataFrame, class_words: int = CLASS_WORDS, training: F.Column | None = None):
        spark = rows.sparkSession
        self.table = coded(rows.select("doc_id", "text", (F.lit(True) if training is None else training).alias("learn")))
        counts = base.written(self.table.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "words")
        self.ends = self.table.where("learn").count()
        facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("types")).first()
        self.total, self.types = facts["n"] + self.ends, facts["types"] + (self.ends > 0)
        self.classes = class_count(facts["types"])
        items = counts.orderBy(F.desc("n"), "word").limit(class_words).collect()
        numbers = spark.createDataFrame([(r["word"], k) for k, r in enumerate(items, REST + 1)], "word string, item int")
        top = base.written(self.table.where("word is not null").join(F.broadcast(numbers), "word").select("block", "place", "item"), "items")
        pairs = pair_counts(self.table, top, len(items) + 2)
        label = exchanged(pairs, self.classes, fixed=2, least=LEAST)
        # the end's class comes before that of the other words, after all others: as neighbours() has it
        label[[END, REST]] = self.classes, self.classes + 1
        settled = [(r["word"], r["n"], int(label[k])) for k, r in enumerate(items, REST + 1)]
        seen = neighbours(self.table, top, label, self.classes)
        self.answers = base.written(chosen_classes(seen, pairs, label, self.classes, settled), "answers")
        self.words = self.answers.where("word is not null").select("word", "n", "class")


def scored(docs: DataFrame, training: F.Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, learned_from) for each row of docs, learning from those where `training` holds."""
    lexicon = Lexicon(docs, training=training)
    rows = base.written(labelled(lexicon.table, lexicon.answers, lexicon.ends), "labelled")
    follow = transitions(rows.where("learn"), lexicon.classes)
    mass, kinds, single = (np.zeros(lexicon.classes, np.int64) for _ in range(3))
    for r in lexicon.words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).collect():
        mass[r["class"]], kinds[r["class"]], single[r["class"]] = r["n"], r["kinds"], r["single"]
    held = base.shared(docs.sparkSession, Scorer(follow, mass, kinds, single, lexicon.ends, lexicon.total, lexicon.types))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches, "labels"):
            found = held().scores(b["n_tokens"].to_numpy(), b["logs"].to_numpy(), b["labels"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_tokens"], b["n_known"], *map(pa.array, found), b["learn"]], ["doc_id", "n_tokens", "n_known", "base_score", "score", "learned_from"])

    out = rows.mapInArrow(f, "doc_id long, n_tokens long, n_known long, base_score double, score double, learned_from boolean")
    return out.withColumn("train_tokens", F.lit(int(lexicon.total)).cast("long"))


def op7_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(base.documents(spark, sf_dir), remainder(7) != 2)
    return out.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", (~F.col("learned_from")).alias("held_out"))
