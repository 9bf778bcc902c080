"""Retrieval of memories: filtered seeds of several collections, a beam over their graph, and payloads last."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..sources.stage import saved
from . import graph, memory


def seeds(vertices: DataFrame, queries: DataFrame, least: float, each: int = 6, **filters: object) -> DataFrame:
    """(query_id, id, score): of each collection the closest vertices that meet all filters (since, tags, kinds), `each` at most."""
    rows = vertices.where(F.col("embedding").isNotNull()).where(memory.conditions(**filters)).select("id", "collection", "embedding")
    rows = rows.crossJoin(F.broadcast(queries.select("query_id", "q"))).select("query_id", "id", "collection", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    place = F.row_number().over(W.partitionBy("query_id", "collection").orderBy(F.desc("score"), "id"))
    return rows.where(F.col("score") >= least).withColumn("n", place).where(F.col("n") <= each).select("query_id", "id", "score")


def retrieved(
    vertices: DataFrame,
    edges: DataFrame,
    queries: DataFrame,
    results: int = 5,
    least: float = 0.7,
    since: float | None = None,
    tags: Sequence[str] = (),
    kinds: Sequence[str] = (),
    collections: Sequence[str] = ("observations", "reflections"),
    reached: Sequence[str] = ("entities",),
    as_of: float = 0.0,
) -> DataFrame:
    """(query_id, id, collection, score, place): what queries (query_id, q) find among vertices (id, collection, embedding, created_at_unix,
    tags, memory_type, status) and edges (src, dst, weight, pattern).

    Seeds meet all filters and have a similarity of `least` or more; the beam goes on to vertices of the collections and of `reached`
    that aren't older than `since`. Each vertex counts once, with the score of its first path; the best `results` are given.
    """
    own = vertices.where(F.col("collection").isin(*collections))
    first = seeds(own, queries, least, since=since, tags=tags, kinds=kinds)
    allowed = vertices.where(F.col("collection").isin(*collections, *reached)).where(memory.conditions(since=since))
    edges = edges.join(allowed.select(F.col("id").alias("dst")), "dst", "left_semi")
    beam = graph.memory_beam(first, edges, allowed, queries, as_of=as_of)
    rows = graph.reached(beam).join(vertices.select("id", "collection"), "id")
    return best(rows, results)


def best(rows: DataFrame, results: int) -> DataFrame:
    """(query_id, id, collection, score, place): the `results` best of rows (query_id, id, collection, score, place), placed anew."""
    last = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "place"))
    return rows.withColumn("n", last).where(F.col("n") <= results).select("query_id", "id", "collection", "score", F.col("n").cast("long").alias("place"))


#: Results that are broadcast to their payloads at most; more are joined by a shuffle.
FEW = 100_000


def with_payloads(rows: DataFrame, payloads: Mapping[str, DataFrame]) -> DataFrame:
    """Results (id, collection, ...) with the columns of their collection's payload (id, ...), the same columns for each. Results without a
    row in their collection, or of another collection, are left out."""
    rows = saved(rows)
    few = rows.count() <= FEW
    out = []
    for name, payload in payloads.items():
        own = rows.where(F.col("collection") == name)
        out.append(payload.join(F.broadcast(own) if few else own, "id"))
    return reduce(DataFrame.unionByName, out)
