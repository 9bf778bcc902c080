"""Fill-in-the-middle transformation with a Roaring-style set of token boundaries.

The ends of a text's tokens are a set of code point offsets. It is kept in containers of 2^16 offsets each, as a sorted array, a bitmap or
runs, whichever is smallest, with the cardinalities of the containers added up. The offset of the k-th boundary is found by a search for
its container and a select inside: an array's entry, a bitmap's word by its summed bit counts, or a run by its summed lengths. So both
cuts are looked up without a list of the tokens.

Texts are cut where they lie, in Arrow batches; nothing is shuffled. Python holds one slice of texts, or one long text, at once.

Defined results: a null text is an empty one, which stays plain; a null doc_id is hashed as an empty string; repeated rows each get
their result; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import base

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT = 10
SPM_PERCENT = 20
#: Offsets that share a container.
SPAN = 1 << 16
#: Bytes of a bitmap, and of an entry of an array and of a run (start and length).
BITMAP_BYTES, ENTRY_BYTES, RUN_BYTES = SPAN // 8, 2, 4
BIT_COUNTS = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class Container:
    """Up to SPAN offsets below SPAN, in the smallest of three forms."""

    def __init__(self, low: np.ndarray):
        breaks = np.flatnonzero(np.diff(low) != 1) + 1
        sizes = {"array": ENTRY_BYTES * len(low), "bitmap": BITMAP_BYTES, "runs": RUN_BYTES * (len(breaks) + 1)}
        self.kind = min(sizes, key=sizes.get)
        self.size = len(low)
        if self.kind == "array":
            self.values = low.astype(np.uint16)
        elif self.kind == "bitmap":
            bits = np.zeros(SPAN, np.uint8)
            bits[low] = 1
            self.words = np.packbits(bits).reshape(-1, 8)
            self.sums = np.cumsum(BIT_COUNTS[self.words].sum(1, dtype=np.int64))
        else:
            at = np.r_[0, breaks]
            self.starts = low[at].astype(np.uint16)
            self.sums = np.r_[breaks, len(low)]

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        if self.kind == "array":
            return int(self.values[k])
        at = int(np.searchsorted(self.sums, k, "right"))
        before = int(self.sums[at - 1]) if at else 0
        if self.kind == "runs":
            return int(self.starts[at]) + k - before
        return at * 64 + int(np.flatnonzero(np.unpackbits(self.words[at]))[k - before])


class BoundarySet:
    """A sorted set of offsets in containers."""

    def __init__(self, offsets: np.ndarray):
        high = offsets // SPAN
        cuts = np.flatnonzero(np.diff(high)) + 1
        groups = np.split(offsets, cuts)
        self.keys = [int(g[0]) // SPAN for g in groups if len(g)]
        self.containers = [Container(g % SPAN) for g in groups if len(g)]
        self.sums = np.cumsum([c.size for c in self.containers], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.sums[-1]) if len(self.sums) else 0

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        at = int(np.searchsorted(self.sums, k, "right"))
        return self.keys[at] * SPAN + self.containers[at].select(k - (int(self.sums[at - 1]) if at else 0))


def boundaries(text: str) -> BoundarySet:
    """Where tokens end: after each character but a letter that another follows."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((codes | 32) - 97) < 26
    inner = np.zeros(len(codes), bool)
    inner[:-1] = letter[:-1] & letter[1:]
    return BoundarySet(np.flatnonzero(~inner) + 1)


def chosen(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    return struct.unpack(">4I", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def transformed(text: str, doc_id: int | None) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of the prefix and of the middle, output)."""
    h1, h2, h3, h4 = chosen(doc_id)
    ends = boundaries(text)
    n = len(ends)
    if not text or h3 % 100 >= 100 - PLAIN_PERCENT or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made of. Marks can't arise where parts meet, as each begins and ends with a character of its own."""
    if form == "plain":
        return output
    start, inner = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(start).split(inner, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


FIELDS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def filled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches):
            rows = [transformed(t or "", i) for t, i in zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), strict=True)]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), FIELDS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *FIELDS])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(f, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def digests(rows: DataFrame) -> DataFrame:
    """rows of filled() with SHA-256 of the output, and of the text that is rebuilt from output and form, in place of the output."""
    names = [c for c in rows.columns if c != "output"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            outputs, forms = b.column("output").to_pylist(), b.column("form").to_pylist()
            made = [pa.array(map(digest, outputs), pa.string()), pa.array((digest(restored(o, k)) for o, k in zip(outputs, forms, strict=True)), pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], [*names, "output_sha256", "restored_sha256"])

    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema if x.name in names)
    return rows.mapInArrow(f, f"{kinds}, output_sha256 string, restored_sha256 string")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(filled(base.documents(spark, sf_dir)))


_PART = "('0x' || substr(h, {}, 8))::bigint"
ORACLE_SQL = f"""
with d as (select doc_id, coalesce("text", '') t, sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
u as (select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') w from d),
c as (select *, len(w) n, {_PART.format(1)} % (len(w) + 1) a, {_PART.format(9)} % (len(w) + 1) b,
    case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or {_PART.format(17)} % 100 >= {100 - PLAIN_PERCENT} then 'plain'
        when {_PART.format(25)} % 100 < {SPM_PERCENT} then 'spm' else 'psm' end form from u),
p as (select *, coalesce(array_to_string(w[1:least(a, b)], ''), '') pre, coalesce(array_to_string(w[least(a, b) + 1:greatest(a, b)], ''), '') mid, coalesce(array_to_string(w[greatest(a, b) + 1:], ''), '') suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end prefix_chars, case when form <> 'plain' then length(mid) end middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid else '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid end) output_sha256,
    sha256(t) restored_sha256 from p
"""
