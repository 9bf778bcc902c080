"""Graph features: neighbour means, layers, losses, training pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import query_templates
from ..functions.vectors import normalized
from ..sources.stage import saved
from .indexing import dense_index


def neighbour_mean(edges: DataFrame, features: DataFrame) -> DataFrame:
    """(id, pos, value): for each target of edges (src, dst) the mean of its sources' features (id, v), by position; partial sums go before the shuffle."""
    rows = edges.select("src", "dst").join(features.select(F.col("id").alias("src"), "v"), "src").select("dst", F.posexplode("v").alias("pos", "x"))
    return rows.groupBy(F.col("dst").alias("id"), "pos").agg(F.avg("x").alias("value"))


def gathered(values: DataFrame) -> DataFrame:
    """(id, v) from (id, pos, value); a vector's length bounds each group."""
    return values.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v"))


def layer(own: DataFrame, means: DataFrame, root: np.ndarray, side: np.ndarray, bias: np.ndarray, relu: bool = True) -> DataFrame:
    """(id, v): root * own + side * mean of neighbours + bias; without neighbours the mean is zero."""
    rows = own.join(means.select("id", F.col("v").alias("m")), "id", "left")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            m = np.array([x if x is not None else [0.0] * v.shape[1] for x in b.column(2).to_pylist()], np.float64).reshape(b.num_rows, -1)
            out = v @ root.T + m @ side.T + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((np.maximum(out, 0) if relu else out).tolist(), pa.list_(pa.float64()))], ["id", "v"])

    kind = own.schema["id"].dataType.simpleString()
    return rows.select("id", "v", "m").mapInArrow(f, f"id {kind}, v array<double>")


def contrastive(pairs: DataFrame, margin: float = 0.5) -> DataFrame:
    """loss, accuracy and mean similarities of rows (label, sim)."""
    loss = F.when(F.col("label") == 1, 1 - F.col("sim")).otherwise(F.greatest(F.lit(0.0), F.col("sim") - margin))
    right = ((F.col("sim") > 0.5).cast("int") == F.col("label")).cast("int")
    mean = lambda y: F.round(F.coalesce(F.avg(F.when(F.col("label") == y, F.col("sim"))), F.lit(0.0)), 6)
    return pairs.agg(F.round(F.avg(loss), 6).alias("loss"), F.round(F.avg(right), 6).alias("accuracy"), mean(1).alias("positive"), mean(0).alias("negative"))


def scaled(v: str, by: float) -> Column:
    return F.transform(v, lambda x: x * by)


def embedded(features: DataFrame, edges: DataFrame, layers: dict[str, list[tuple]], attention: dict[str, float], project: np.ndarray) -> DataFrame:
    """(id, v): graph embeddings of features (id, v) over edges (src, dst, kind), with norm one.

    layers: of each kind of edge its layers (root, side, bias), ReLU between them; kinds that have edges are combined by the softmax of
    their attention. Without any edges the features are projected.
    """
    found = {r["kind"] for r in edges.select("kind").distinct().collect()} & layers.keys()
    kinds = [k for k in layers if k in found]
    if not kinds:
        zero = features.sparkSession.createDataFrame([], f"id {features.schema['id'].dataType.simpleString()}, v array<double>")
        combined = layer(features, zero, project, np.zeros_like(project), np.zeros(len(project)), relu=False)
    else:
        power = np.exp(np.array([attention[k] for k in kinds]) - max(attention[k] for k in kinds))
        combined = None
        for kind, share in zip(kinds, power / power.sum(), strict=True):
            own, h = edges.where(F.col("kind") == kind), features
            for n, (root, side, bias) in enumerate(layers[kind]):
                h = layer(h, gathered(neighbour_mean(own, h)), root, side, bias, relu=n < len(layers[kind]) - 1)
            h = h.select("id", scaled("v", float(share)).alias("v"))
            combined = h if combined is None else combined.join(h.withColumnRenamed("v", "w"), "id").select("id", F.zip_with("v", "w", lambda x, y: x + y).alias("v"))
    return combined.select("id", normalized(F.col("v")).alias("v"))


def embedded_new(new: DataFrame, edges: DataFrame, features: DataFrame, **model: object) -> DataFrame:
    """(id, v) of new vertices (id, v) alone: only they and what lies within as many edges of them as there are layers are looked at."""
    depth = max(len(x) for x in model["layers"].values())
    near = new.select("id")
    for _ in range(depth):
        near = near.unionByName(edges.join(near.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))).distinct()
    part = edges.join(near.select(F.col("id").alias("dst")), "dst", "left_semi")
    own = features.join(near, "id", "left_semi").join(new.select("id"), "id", "left_anti").unionByName(new.select("id", "v"))
    return embedded(own, part, **model).join(new.select("id"), "id", "left_semi")


def edge_weights(edges: DataFrame) -> DataFrame:
    """(kind, n, unweighted, total, least, most): how many edges (kind, props: map) of each kind there are, and the sum, least and most of their weights. An edge
    without the key `weight` has 1.0; a weight that is there and null stays null."""
    weight = F.when(F.map_contains_key("props", F.lit("weight")), F.col("props")["weight"].cast("double")).otherwise(F.lit(1.0))
    rows = edges.select("kind", weight.alias("w"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("w").isNull(), 1)).alias("unweighted"), F.sum("w").alias("total"), F.min("w").alias("least"), F.max("w").alias("most"))


def query_pairs(files: DataFrame, ratio: float = 2.0, seed: str = "pairs") -> DataFrame:
    """(query, id, label) of files (id, path, text): each question that a file answers with the file, label 1, and `ratio` times as many
    pairs with another file, label 0: the files in turn that a hash picks, the next one where it picks the file itself."""
    numbered = saved(dense_index(files.select("id", "path", "text"), "id", "n"))
    size = numbered.count()
    good = saved(numbered.select("id", "n", F.posexplode(query_templates(F.col("path"), F.col("text"))).alias("k", "query")))
    whole, part = int(ratio), ratio - int(ratio)
    place = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("n").cast("string"), F.col("k").cast("string"), salt)), 1, 8), 16, 10).cast("long")
    times = F.lit(whole) + (place(F.lit("part")) < int(part * (1 << 32))).cast("int")
    bad = good.withColumn("i", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    pick = place(F.col("i").cast("string")) % size
    bad = bad.withColumn("other", F.when(pick == F.col("n"), (pick + 1) % size).otherwise(pick)).where(F.lit(size > 1))
    bad = bad.select("query", "other").join(numbered.select(F.col("n").alias("other"), "id"), "other").select("query", "id", F.lit(0).alias("label"))
    return good.select("query", "id", F.lit(1).alias("label")).unionByName(bad)
