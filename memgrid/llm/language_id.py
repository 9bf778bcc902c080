"""Language identification by interpolated Kneser-Ney character models, one column for each language.

Models learn from a bounded sample of the labelled rows (train_chars code points a language, the bound of what the driver holds and
broadcasts; rows are chosen by a hash of doc_id). A text's language is the one with the lowest cross-entropy for each symbol. Labelled
rows of the sample that weren't counted calibrate the score (a softmax over cross-entropies with a fitted scale) and, for each
language, the highest cross-entropy that is accepted.

Symbols are lower-case letters; each run of other characters is one space. Case, digits and punctuation thus don't matter.

Defined results: a text that is null or has no letter is `und` with score 0 and not accepted; so is every text if nothing can be
learned from; a language whose texts are all empty isn't learned; ties go to the language that sorts first; a null doc_id is hashed as an empty string; null labels are never learned
from; repeated rows each get their result; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .kneser_ney import Model, code_points, counted, padded_codes

ORDER, BITS = 5, 12
TRAIN_CHARS = 2_000_000
#: Standard deviations of the calibration rows' cross-entropy above their mean that are accepted.
ACCEPTED = 6.0

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, and the document of each."""
    points, doc = code_points([t.lower() for t in texts])
    symbols = np.where(points < 2048, points, 2048 + base.mix64(points) % np.uint64(2047)).astype(np.uint64)
    symbols[~letters()[points]] = 0
    some = symbols > 0
    kept = some.copy()
    kept[1:] |= some[:-1]
    return padded_codes(symbols[kept], doc[kept], len(texts), ORDER, BITS), doc[kept]


class Languages:
    def __init__(self, names: list[str], model: Model | None, scale: float = 1.0, limits: np.ndarray | None = None):
        self.names, self.model, self.scale = names, model, scale
        self.limits = np.full(len(names), np.inf) if limits is None else limits


def cross_entropies(languages: Languages, texts: list[str]) -> np.ndarray:
    """Nats a symbol, a row for each text; infinite for texts without letters."""
    codes, doc = coded(texts)
    n = np.bincount(doc, minlength=len(texts))
    total = np.zeros((len(texts), len(languages.names)))
    for at in range(0, len(codes), 1 << 19):
        some, own = languages.model.scores(codes[at : at + (1 << 19)]), doc[at : at + (1 << 19)]
        heads = np.flatnonzero(np.r_[True, np.diff(own) != 0])
        total[own[heads]] -= np.add.reduceat(some, heads, axis=0, dtype=np.float64)
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], np.inf)


def remainder(modulus: int) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def learned(rows: DataFrame, train_chars: int = TRAIN_CHARS) -> Languages:
    """Models from rows (doc_id, text, lang); rows without a label or text are left out."""
    rows = rows.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect() if r["n"]}
    names = sorted(sizes)
    if not names:
        return Languages([], None)
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, train_chars / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    rows = base.written(rows.where(place < share), "sample")
    spare = F.pmod(F.xxhash64("doc_id", F.lit("spare")), F.lit(10)) == 0
    got = counted(rows.where(~spare), "lang", coded).toArrow()
    if not got.num_rows:
        got = counted(rows, "lang", coded).toArrow()
    if not got.num_rows:
        return Languages([], None)
    codes, at = np.unique(got["code"].to_numpy().view(np.uint64), return_inverse=True)
    column = np.searchsorted(np.array(names), np.array(got["lang"].to_pylist()))
    counts = np.zeros((len(codes), len(names)))
    np.add.at(counts, (at, column), got["n"].to_numpy())
    symbols = len(np.unique(codes & np.uint64((1 << BITS) - 1))) + 1
    out = Languages(names, Model(codes, counts, ORDER, BITS, symbols, modified=False))
    calibrate(out, rows.where(spare))
    return out


def calibrate(out: Languages, rows: DataFrame) -> None:
    out.limits = np.full(len(out.names), np.inf)
    shared = base.shared(rows.sparkSession, out)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches, limit=1 << 20):
            nats = cross_entropies(shared(), [t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nats.tolist(), pa.list_(pa.float64()))], ["lang", "nats"])

    got = rows.select("lang", "text").mapInArrow(f, "lang string, nats array<double>").toArrow()
    if not got.num_rows:
        return
    nats, own = np.array(got["nats"].to_pylist()), np.searchsorted(np.array(out.names), np.array(got["lang"].to_pylist()))
    fine = np.isfinite(nats).all(axis=1)
    nats, own = nats[fine], own[fine]
    if not len(own):
        return
    best = np.inf
    for scale in (1, 2, 4, 8, 16, 32, 64):
        z = -scale * (nats - nats.min(axis=1, keepdims=True))
        loss = np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(own)), own])
        if loss < best - 1e-4:
            best, out.scale = loss, float(scale)
    for k in range(len(out.names)):
        mine = nats[own == k, k]
        if len(mine) > 1:
            out.limits[k] = mine.mean() + ACCEPTED * max(mine.std(), 0.01)


def identified(docs: DataFrame, languages: Languages) -> DataFrame:
    """(doc_id, lang_pred, score, nats, accepted) for each row of docs; only text is looked at."""
    shared = base.shared(docs.sparkSession, languages)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches, limit=1 << 20):
            own, n = shared(), b.num_rows
            texts = [t or "" for t in b.column(1).to_pylist()]
            names, score, low, good = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
            if own.names:
                nats = cross_entropies(own, texts)
                at = nats.argmin(axis=1)
                low = nats[np.arange(n), at]
                fine = np.isfinite(low)
                shift = np.where(fine[:, None], nats - np.where(fine, low, 0)[:, None], 0)
                score = np.where(fine, 1 / np.exp(-own.scale * shift).sum(axis=1), 0)
                good = fine & (low <= own.limits[at])
                names = [own.names[k] if ok else "und" for k, ok in zip(at.tolist(), fine.tolist(), strict=True)]
            low = pa.array(low, mask=~np.isfinite(low))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(score), low, pa.array(good)], ["doc_id", "lang_pred", "score", "nats", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, nats double, accepted boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    languages = learned(docs.where(remainder(5) != 0))
    return identified(docs, languages).withColumn("held_out", remainder(5) == 0)
