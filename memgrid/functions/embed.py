"""Embeddings of texts: a hashing embedder of column functions, and a hook for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .texts import let, window_words
from .vectors import norm


def _place(word: Column, size: int) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % size).cast("int")


def hashed(text: Column, size: int = 64) -> Column:
    """Word counts of a text by a hash of the lower-case word, with norm one; without words all zero. Each step is worked out once."""
    zero = F.array_repeat(F.lit(0.0), size)
    runs = lambda places: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.size(F.filter(places, lambda x: x == p)).cast("double"))
    scaled = lambda counts: let(norm(counts), lambda length: F.when(length > 0, F.transform(counts, lambda x: x / length)).otherwise(zero))
    places = F.transform(window_words(F.lower(F.coalesce(text, F.lit("")))), lambda w: _place(w, size))
    return let(places, lambda found: let(runs(found), scaled))


def hashed_places(docs: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, pos, value) of the places of hashed() that aren't zero, for long texts: each word is hashed once, and counts are added up.

    Rows are told apart by their place in the table, so equal keys are vectors of their own. Counts are made where the text lies; at most
    `size` rows of a text are shuffled.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    words = rows.select("_row", "_key", F.explode(window_words(F.lower("_text"))).alias("_word"))
    counts = words.groupBy("_row", "_key", _place(F.col("_word"), size).alias("pos")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    length = F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(W.partitionBy("_row", "_key")))
    return counts.select(F.col("_key").alias(key), "pos", (F.col("_n") / length).alias("value"))


def normalized(vectors: np.ndarray) -> np.ndarray:
    """Rows with norm one, as float32; zero rows stay."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(size > 0, size, 1)).astype(np.float32)


def embedded(docs: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray], size: int, batch: int = 32, task: str = "retrieval.query") -> DataFrame:
    """(key, embedding) of each row by a model, batch by batch in Arrow; norm one.

    The prompt is `query` unless the task's name has `passage` in it, as for documents and queries alike. A null or empty text is a zero vector.
    """
    prompt = "passage" if "passage" in task else "query"

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            own = t[text].fillna("")
            out = np.zeros((len(t), size), np.float32)
            full = np.flatnonzero(own.str.len().to_numpy() > 0)
            for at in range(0, len(full), batch):
                some = full[at : at + batch]
                out[some] = normalized(np.asarray(model([f"{prompt}: {x}" for x in own.iloc[some]]), np.float64))
            yield pd.DataFrame({key: t[key], "embedding": list(out)})

    return docs.select(key, text).mapInPandas(f, f"`{key}` {docs.schema[key].dataType.simpleString()}, embedding array<float>")
