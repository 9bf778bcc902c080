"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root names the component.

    In each round every node joins the one that comes first among all up to two edges away, and edges move to what their ends joined. The
    order is a hash that differs from round to round, so nodes fall by a constant factor in each, along ascending chains too, the rounds
    are logarithmic in a component's size, and a star is one round. No node's neighbours are ever gathered, only their first. What was
    joined in each round, tables that shrink like the edges, is put together at the end. Nulls aren't nodes. An empty table gives an
    empty one.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = base.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        place = lambda x, k=len(rounds): F.struct(F.xxhash64(x, F.lit(k)).alias("place"), F.col(x).alias("node"))
        first = edges.groupBy("a").agg(F.min(place("b")).alias("near")).select(F.col("a").alias("node"), F.least(place("a"), "near").alias("near"))
        second = edges.join(first, F.col("b") == F.col("node")).groupBy("a").agg(F.min("near").alias("near"))
        joined = base.written(second.select(F.col("a").alias("node"), F.col("near.node").alias("root")), "joined")
        rounds.append(joined)
        a, b = joined.select(F.col("node").alias("a"), F.col("root").alias("ra")), joined.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = base.written(edges, "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds.pop()
    while rounds:
        step = found.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = rounds.pop().join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return base.written(found, "roots")
