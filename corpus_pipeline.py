"""The corpus pipeline: quality rules, near-duplicates, benchmark items, secrets, and the mix of sources.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written before the next one starts. All but the
last return the columns of documents. No SQL states the first stages (language model, fingerprints), so ORACLE_SQL is None and the
tests hold the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgrid.llm import base, decontaminate, mixture, near_copies, quality, secret_scan

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the perplexity bands reject."""
    return quality.filtered(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of documents that share 0.8 of their five-word shingles."""
    return near_copies.deduplicated(docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret; n_chars is that of the new text."""
    out = secret_scan.redacted(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixture.mixed(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near copies", drop_near_copies),
    ("benchmark items", drop_benchmark_items),
    ("secrets", redact_secrets),
    ("mix of sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before made on their way is removed once each is written."""
    docs, since = base.documents(spark, sf_dir), base.made()
    for name, stage in STAGES[:-1]:
        docs = base.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        base.cleared(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
