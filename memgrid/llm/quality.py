"""Quality rules: a modified Kneser-Ney N-gram model of the whole corpus, and perplexity bands by language.

N-grams are of ORDER UTF-16 code units as they stand (runs of white space are one space), so that case, digits, marks and letters of all
scripts count as what they are. Spark counts them over all rows; the model grows with the corpus and no machine holds it: its sorted
arrays of n-grams lie in parts by hash, each block of documents asks the parts for its distinct n-grams, and log probabilities come back.

A text has two perplexities: the surprise of all its code units spread over its words, and over its code units. A run of symbols after
each word shows in the first only (in the second its foreseen repetition hides its surprise), odd sequences of usual words more in the
second. For each of them and each language (the lang column) the band lies around the median of the logarithm over all its texts, in robust standard deviations, wider for short texts, whose mean varies more. How many deviations it reaches down and
up is read from the scores of all texts that pass the base rules: each tail is cut where it has left the body, at its first valley or
gap from TAIL deviations on. No label is used, and no share of the rows is fixed.

Defined results: a null or empty text has no words and fails the base rules; null languages are a language of their own; the middle and
spread of a language lean towards those of all texts, the more the fewer texts it has (PRIOR_TEXTS); repeated rows each get their
result; an empty table gives an empty one; extra columns, whatever their names, are kept by `filtered` and ignored by `judged`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import base
from .kneser_ney import counted, padded_codes, probabilities

ORDER, BITS = 4, 16
#: Deviations from which a score may be an outlier (the usual cut of median-based z-scores); the least standard deviation.
TAIL, LEAST_SPREAD = 3.5, 0.02
#: Scores are counted in steps of 1 / STEPS deviations, those over FAR steps together.
STEPS, FAR = 4, 400
#: A text of so many words gets twice the band.
SHORT = 25
#: All texts together count as so many texts of each language.
PRIOR_TEXTS = 5
#: Bands (one a language) that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 10_000
#: Base rules. Fixed values.
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = "#*$%&|<>"


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, runs of white space and controls taken as one space, and the document of each."""
    line = "\n".join(texts) + "\n"
    units = np.frombuffer(line.encode("utf-16-le", "surrogatepass"), np.uint16)
    sizes = np.fromiter((len(t.encode("utf-16-le", "surrogatepass")) // 2 + 1 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes)
    space = units <= 32
    kept = ~space
    kept[1:] |= kept[:-1]
    return padded_codes(np.where(space, 32, units)[kept].astype(np.uint64), doc[kept], len(texts), ORDER, BITS), doc[kept]


def repeated_words(words: list[bytes], window: int) -> int:
    """Words in windows that are found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, len(words))
    hashes = base.Rolling(base.mix64(ids)).windows(window)
    _, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[at] > 1)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + window, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1]) > 0))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(base.SPACES):
            seen.add(line)
    chars = len(text) - sum(text.count(c) for c in base.SPACES)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), again, repeated_words(words, REPEAT_WINDOW)


#: The two perplexities: their logarithms, and the ends of their bands.
MEASURES = {"log_perplexity": ("low", "high"), "unit_log_perplexity": ("unit_low", "unit_high")}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def parts_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the model that has each n-gram."""
    return (base.mix64(codes) % np.uint64(parts)).astype(np.int32)


def parted(model: DataFrame, parts: int) -> DataFrame:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(parts_of(b.column(0).to_numpy().view(np.uint64), parts)), *b.columns], ["part", "code", "logp"])

    return model.mapInArrow(f, "part int, code long, logp float")


def asker(parts: int) -> Callable:
    """(part, block, codes): the block's distinct n-grams, in order, by the part that has them."""

    def f(t: pa.Table) -> pa.Table:
        texts = base.field(t, "doc.text")
        found = [np.unique(coded([x or "" for x in b.column(0).to_pylist()])[0]) for b in base.slices(pa.table([texts], ["text"]).to_batches(), limit=1 << 20)]
        codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        part = parts_of(codes, parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, codes[order[a:z]].tobytes()) for p, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if z > a]
        block = t.column("block")[0].as_py() if len(t) else 0
        return pa.table([pa.array([p for p, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "block", "codes"])

    return f


def answered(asked: pa.Table, model: pa.Table) -> pa.Table:
    """(block, codes, logps) for each block that asks a part of the model."""
    schema = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("logps", pa.binary())])
    if not len(asked):
        return schema.empty_table()
    model = model.combine_chunks()
    codes = model.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    codes, logps = codes[order], model.column("logp").to_numpy()[order]
    found = [logps[np.searchsorted(codes, np.frombuffer(x, np.uint64))].tobytes() for x in asked.column("codes").to_pylist()]
    return pa.table([asked.column("block").combine_chunks(), asked.column("codes").combine_chunks(), pa.array(found, pa.binary())], schema=schema)


def measurer(schema: pa.Schema) -> Callable:
    """(row, block, doc_id, lang, COUNTS, MEASURES) of the block's documents, from the log probabilities of its n-grams."""

    def f(t: pa.Table, r: pa.Table) -> pa.Table:
        if not len(t):
            return schema.empty_table()
        codes = np.frombuffer(b"".join(r.column("codes").to_pylist()), np.uint64)
        order = np.argsort(codes)
        codes, logps = codes[order], np.frombuffer(b"".join(r.column("logps").to_pylist()), np.float32)[order]
        doc = t.column("doc").combine_chunks()
        nats: tuple[list[np.ndarray], list[np.ndarray]] = [], []
        counts: list[tuple[int, ...]] = []
        for b in base.slices(pa.table([pa.compute.struct_field(doc, "text")], ["text"]).to_batches(), limit=1 << 20):
            texts = [x or "" for x in b.column(0).to_pylist()]
            own, owner = coded(texts)
            total = np.bincount(owner, logps[np.searchsorted(codes, own)], len(texts)) if len(own) else np.zeros(len(texts))
            counts.extend(base_counts(x) for x in texts)
            words = np.array([x[0] for x in counts[-len(texts) :]])
            for k, n in enumerate((words, np.bincount(owner, minlength=len(texts)))):
                nats[k].append(np.where(n > 0, -total / np.maximum(n, 1), np.nan))
        found = [np.concatenate(x) for x in nats]
        columns = [t.column("row").combine_chunks(), t.column("block").combine_chunks(), pa.compute.struct_field(doc, "doc_id"), pa.compute.struct_field(doc, "lang").cast(pa.string())]
        columns += [pa.array(c) for c in np.array(counts, np.int64).reshape(-1, len(COUNTS)).T]
        return pa.table([*columns, *(pa.array(x, mask=np.isnan(x)) for x in found)], schema=schema)

    return f


def measured(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents as a table (block, row, doc), bucketed by block, and (row, block, doc_id, lang, COUNTS, MEASURES) of each."""
    grams = base.written(counted(docs.select(F.lit("all").alias("corpus"), "text"), "corpus", coded).select("code", "n"), "grams")
    model = probabilities(grams, ORDER, BITS)
    parts = base.parts_for(docs, 32 << 20)
    rows = base.packed(docs, "quality")
    by_block = rows.groupBy("block")
    asked = by_block.applyInArrow(asker(parts), "part int, block long, codes binary")
    answers = asked.groupBy("part").cogroup(parted(model, parts).groupBy("part")).applyInArrow(answered, "block long, codes binary, logps binary")
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("row", pa.int64()), ("block", pa.int64()), ("doc_id", to_arrow_type(kind)), ("lang", pa.string()), *((c, pa.int64()) for c in COUNTS), *((c, pa.float64()) for c in MEASURES)])
    out = by_block.cogroup(answers.groupBy("block")).applyInArrow(measurer(schema), f"row long, block long, doc_id {kind.simpleString()}, lang string, {' long, '.join(COUNTS)} long, {' double, '.join(MEASURES)} double")
    return rows, base.written(out, "measured")


def scales(rows: DataFrame) -> DataFrame:
    """(lang, middle, spread) of log_perplexity, from all rows (lang, log_perplexity)."""
    middle = rows.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle"), F.count("log_perplexity").alias("texts"))
    middle = middle.select(F.col("lang").alias("_lang"), "middle", "texts")
    off = rows.join(middle, F.col("lang").eqNullSafe(F.col("_lang"))).groupBy("_lang", "middle", "texts").agg(F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10000).alias("off"))
    median = lambda x: rows.agg(F.percentile_approx(x, 0.5, 10000)).first()[0] or 0.0
    all_middle = median(F.col("log_perplexity"))
    all_off = median(F.abs(F.col("log_perplexity") - all_middle))
    leaning = lambda own, whole: (F.coalesce(F.col(own), F.lit(whole)) * F.col("texts") + F.lit(whole * PRIOR_TEXTS)) / (F.col("texts") + PRIOR_TEXTS)
    return off.select("_lang", leaning("middle", all_middle).alias("middle"), F.greatest(F.lit(LEAST_SPREAD), leaning("off", all_off) * 1.4826).alias("spread"))


def tail_limit(counts: dict[int, int]) -> float:
    """Where a tail leaves the body: the first place from TAIL deviations on around which (half a deviation to each side) lie no more
    scores than around any place up to a deviation further out. counts: scores by whole steps outward."""
    around = lambda k: sum(counts.get(x, 0) for x in range(k - STEPS // 2, k + STEPS // 2))
    k = round(TAIL * STEPS)
    while any(around(k + x) < around(k) for x in range(1, STEPS + 1)):
        k += 1
    return k / STEPS


def limits(far: DataFrame) -> tuple[float, float]:
    """Deviations below and above the middle that the bands reach, from all rows (far)."""
    step = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.floor(F.col("far") * STEPS)))
    counts = {r["step"]: r["n"] for r in far.where("far is not null").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return tail_limit({-1 - k: n for k, n in counts.items() if k < 0}), tail_limit({k: n for k, n in counts.items() if k >= 0})


def ruled(rows: DataFrame) -> DataFrame:
    """Measured rows with base_failed, the ends of the bands, and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows, kept = rows.withColumn("base_failed", failed), ~F.col("base_failed")
    for measure, (low, high) in MEASURES.items():
        found = base.written(scales(rows.select("lang", F.col(measure).alias("log_perplexity"))), "bands")
        found = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
        rows = rows.join(found, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        unit = F.col("spread") * (1 + F.lit(float(SHORT)) / F.greatest(F.col("n_words"), F.lit(1)))
        below, above = limits(rows.where(~F.col("base_failed")).select(((F.col(measure) - F.col("middle")) / unit).alias("far")))
        rows = rows.withColumns({low: F.col("middle") - below * unit, high: F.col("middle") + above * unit}).drop(*found.columns)
        kept = kept & F.coalesce(F.col(measure).between(F.col(low), F.col(high)), F.lit(True))
    return rows.withColumn("kept", kept)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, COUNTS, MEASURES, base_failed, the ends of their bands, kept) for each row."""
    return ruled(measured(docs.select("doc_id", "lang", "text"))[1]).drop("row", "block")


def filtered(docs: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject, all columns as they are."""
    rows, found = measured(docs)
    return base.chosen(rows, ruled(found).where("kept").select("row", "block"), docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(base.documents(spark, sf_dir)).drop("lang")
