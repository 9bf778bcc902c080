"""Interpolated and modified Kneser-Ney models over symbols, stored in sorted hash arrays.

An n-gram is the number made of its symbols, `bits` each. Of every order the model keeps the sorted hashes of the n-grams that were
seen with their log probabilities, already interpolated with all lower orders, and of the contexts with the logs of the mass they
leave to the lower order. One model holds several columns (languages) over the union of their n-grams.

`probabilities` makes the same of a table of counts with joins, for models that no machine need hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base


def from_counts(n1: float, n2: float, n3: float, n4: float, modified: bool) -> list[float]:
    """What is taken off a count of 1, 2 and 3 or more; n1 to n4: how many n-grams have a count of 1 to 4."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    if not modified:
        return [y, y, y]
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), most) for x, most in zip(found, (0.95, 1.95, 2.95), strict=True)]


def discounts(counts: np.ndarray, modified: bool) -> np.ndarray:
    return np.array(from_counts(*(float((counts == k).sum()) for k in (1, 2, 3, 4)), modified))


def probabilities(grams: DataFrame, order: int, bits: int) -> DataFrame:
    """(code, logp): of every n-gram of `order` symbols that was seen its modified Kneser-Ney log probability, interpolated.

    grams: (code, n), each code once, n over 0. A join's key (a context, a shorter n-gram) has at most as many rows as there are symbols.
    """
    tables = {order: grams}
    for k in range(order - 1, 0, -1):
        code = F.col("code").bitwiseAND(F.lit((1 << (bits * k)) - 1))
        tables[k] = base.written(tables[k + 1].groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")), f"grams{k}")
    lower = None
    for k in range(1, order + 1):
        few = {r["n"]: r["grams"] for r in tables[k].where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("grams")).collect()}
        one, two, more = from_counts(*(few.get(n, 0) for n in (1, 2, 3, 4)), True)
        taken = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        rows = tables[k].select("code", "n", F.shiftrightunsigned("code", bits).alias("context"), taken.alias("taken"))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("taken").alias("left"))
        rows = rows.join(contexts, "context")
        if lower is None:
            below: Column = F.lit(1.0 / (tables[1].count() + 1))
        else:
            rows = rows.withColumn("_lower", F.col("code").bitwiseAND(F.lit((1 << (bits * (k - 1))) - 1))).join(lower.select(F.col("code").alias("_lower"), "prob"), "_lower")
            below = F.col("prob")
        lower = rows.select("code", ((F.col("n") - F.col("taken") + F.col("left") * below) / F.col("total")).alias("prob"))
    return base.written(lower.select("code", F.ln("prob").cast("float").alias("logp")), "probabilities")


class Model:
    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, bits: int, symbols: int, modified: bool):
        """codes: distinct n-grams of the highest order; counts: theirs, a column for each language; symbols: how many there can be."""
        self.order, self.bits = order, bits
        grams, tables = {order: codes.astype(np.uint64)}, {order: counts.astype(np.float64)}
        for n in range(order - 1, 0, -1):
            tail = grams[n + 1] & np.uint64((1 << (bits * n)) - 1)
            grams[n], at = np.unique(tail, return_inverse=True)
            tables[n] = np.zeros((len(grams[n]), counts.shape[1]))
            np.add.at(tables[n], at, tables[n + 1] > 0)
        self.floor = np.full(counts.shape[1], -np.log(symbols), np.float32)
        lower = np.full((1, counts.shape[1]), 1 / symbols)
        self.grams, self.contexts = [], []
        for n in range(1, order + 1):
            code, table = grams[n], tables[n]
            context, at = np.unique(code >> np.uint64(bits), return_inverse=True)
            total, left, taken = (np.zeros((len(context), table.shape[1])) for _ in range(3))
            off = np.zeros_like(table)
            for c in range(table.shape[1]):
                d = discounts(table[:, c], modified)
                off[:, c] = np.where(table[:, c] > 0, d[np.clip(table[:, c].astype(np.int64), 1, 3) - 1], 0)
            np.add.at(total, at, table)
            np.add.at(taken, at, off)
            left = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
            below = lower[np.searchsorted(grams[n - 1], code & np.uint64((1 << (bits * (n - 1))) - 1))] if n > 1 else lower
            prob = (table - off) / np.maximum(total, 1)[at] + left[at] * below
            lower = prob
            self.grams.append(self.stored(code, np.log(prob)))
            self.contexts.append(self.stored(context, np.log(left)))

    @staticmethod
    def stored(codes: np.ndarray, values: np.ndarray) -> tuple[base.HashArray, np.ndarray]:
        keys = base.mix64(codes)
        order = np.argsort(keys)
        return base.HashArray(keys[order]), np.ascontiguousarray(values[order].astype(np.float32))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of each n-gram's last symbol, a column for each language."""
        out = np.zeros((len(codes), len(self.floor)), np.float32)
        rest = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            code = codes[rest] & np.uint64((1 << (self.bits * n)) - 1)
            keys, values = self.grams[n - 1]
            at = keys.find(base.mix64(code))
            hit = at >= 0
            out[rest[hit]] += values[at[hit]]
            rest, code = rest[~hit], code[~hit]
            if not len(rest):
                break
            keys, values = self.contexts[n - 1]
            at = keys.find(base.mix64(code >> np.uint64(self.bits)))
            hit = at >= 0
            out[rest[hit]] += values[at[hit]]
        out[rest] += self.floor
        return out


def padded_codes(symbols: np.ndarray, doc: np.ndarray, docs: int, order: int, bits: int) -> np.ndarray:
    """The n-gram that ends at each symbol; before a document stand zeros."""
    at = np.arange(len(symbols)) + (order - 1) * (doc + 1)
    line = np.zeros(len(symbols) + (order - 1) * (docs + 1), np.uint64)
    line[at] = symbols
    code = line[at]
    for k in range(1, order):
        code |= line[at - k] << np.uint64(bits * k)
    return code


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line feed after each, and the document of each."""
    line = "\n".join(texts) + "\n"
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)


def counted(docs: DataFrame, column: str, coder: Callable, limit: int = 1 << 20) -> DataFrame:
    """(column, code, n): how often each n-gram occurs, over all rows of docs (column, text). Each task sends every n-gram once or a few times."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush(name):
            codes, counts = (np.concatenate(x) for x in zip(*held.pop(name), strict=True))
            codes, at = np.unique(codes, return_inverse=True)
            return codes, np.bincount(at, counts, len(codes)).astype(np.int64)

        def batch(name, codes, counts):
            return pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], [column, "code", "n"])

        for b in base.slices(batches, limit=limit):
            names = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            for name in set(names):
                codes, _ = coder([t or "" for t, own in zip(texts, names, strict=True) if own == name])
                held.setdefault(name, []).append(np.unique(codes, return_counts=True))
                if len(held[name]) > 1 and sum(len(x) for x, _ in held[name]) > 2 * limit:
                    codes, counts = flush(name)
                    if len(codes) > limit:
                        yield batch(name, codes, counts)
                    else:
                        held[name] = [(codes, counts)]
        for name in list(held):
            yield batch(name, *flush(name))

    rows = docs.select(F.col(column).cast("string").alias(column), "text").mapInArrow(f, f"{column} string, code long, n long")
    return rows.groupBy(column, "code").agg(F.sum("n").alias("n"))
