"""Traversals by breadth, and training over the graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, learning, training
from ..sources.stage import shared_folder
from .registry import query
from .tables import Tables

_PRUNED = "regexp_matches(id, '^nation/\\d*[05]$')"


def _walk(ways: str, hops: int, pruned: str) -> str:
    return f"""with recursive e as ({ways}), s as (select 'region/' || r_regionkey seed from region),
    r as (select seed, seed id, 0 depth from s union select r.seed, e.b, r.depth + 1 from r join e on e.a = r.id where r.depth < {hops} and not {pruned.replace('id', 'r.id')}),
    m as (select seed, id, min(depth) depth from r group by all)
    select m.seed, m.id, m.depth, case when m.depth > 0 then min(p.id) end parent from m left join e on e.b = m.id left join m p on p.seed = m.seed and p.id = e.a and p.depth = m.depth - 1 and not {pruned.replace('id', 'p.id')} group by m.seed, m.id, m.depth"""



_OUT = "select 'region/' || n_regionkey a, 'nation/' || n_nationkey b from nation union all select 'nation/' || c_nationkey, 'customer/' || c_custkey from customer union all select 'customer/' || o_custkey, 'orders/' || o_orderkey from orders"


@query(_walk(_OUT, 3, _PRUNED))
def walk_outbound(t: Tables) -> DataFrame:
    """From each region to its orders, level by level; some nations are found and not gone on from."""
    seeds = t.read("region").select(F.concat(F.lit("region/"), "r_regionkey").alias("id"))
    return graph.breadth_first(t.containment, seeds.select(F.col("id").alias("seed"), "id"), 3, "outbound", F.col("id").rlike(r"^nation/\d*[05]$"))


@query(
    _walk("select * from (" + _OUT.replace(" union all select 'customer/' || o_custkey, 'orders/' || o_orderkey from orders", "") + ") union all select b, a from (" + _OUT.replace(" union all select 'customer/' || o_custkey, 'orders/' || o_orderkey from orders", "") + ")", 3, "id = ''").replace(
        "select 'region/' || r_regionkey seed from region", "select 'customer/' || c_custkey seed from customer where c_custkey % 100 = 0"
    )
)
def walk_any(t: Tables) -> DataFrame:
    """From some customers up and down again: three edges in either direction, each vertex once."""
    edges = t.containment.where("src not like 'customer/%'")
    seeds = t.read("customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"))
    return graph.breadth_first(edges, seeds.select(F.col("id").alias("seed"), "id"), 3, "any")


def training_pairs(t: Tables) -> DataFrame:
    """Pairs of labels: the vector of a document, and vector and neighbours' mean of the one after it."""
    features = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    means = learning.gathered(learning.neighbour_mean(t.knn_edges, features))
    labels = t.read("labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") + 1).alias("other"), F.col("quality").alias("label"))
    return training.pairs_of(labels, features, means)


@query()
def training_history(t: Tables) -> DataFrame:
    """Losses and rate by epoch of the graph model on the labels; every fifth document is held out."""
    pairs = training_pairs(t)
    held = F.pmod(F.col("id"), F.lit(5)) == 0
    state = training.trained(pairs.where(~held), pairs.where(held), 64, 8, training.Settings(epochs=6), f"{shared_folder(t.spark)}/memgrid-training-{uuid.uuid4().hex}")
    rows = [(n + 1, *x) for n, x in enumerate(zip(state.train_losses, state.valid_losses, state.rates, strict=True))]
    return t.spark.createDataFrame(rows, "epoch int, train_loss double, valid_loss double, rate double")
