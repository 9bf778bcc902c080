"""Edges, neighbour expansion and capped beam search, for many queries at once.

A beam is a table: (query_id, rank, path, tail, score); paths carry ids only, payloads are joined at the end. A hop is a join with edges
whose fan-out is capped by a window, a score, and a window that cuts the beam. All orders are total, so results repeat.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.scores import recency
from ..functions.vectors import cosine, diversity, norm
from ..sources.stage import saved


def contains_edges(files: DataFrame) -> DataFrame:
    """Directory to file, for rows (path)."""
    return files.select(F.concat(F.lit("dir:"), texts.directory(F.col("path"))).alias("src"), texts.safe_key(F.col("path")).alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """An edge for each import statement (path, statement) that names one of files (path); not deduplicated."""
    keys = files.select(texts.safe_key(F.col("path")).alias("dst"))
    rows = imports.select(texts.safe_key(F.col("path")).alias("src"), texts.import_key(F.col("statement"), F.col("path")).alias("dst"), F.substring("statement", 1, 200).alias("statement"))
    return rows.join(keys, "dst", "left_semi").select("src", "dst", F.lit("imports").alias("kind"), F.lit(1.0).alias("weight"), "statement")


def reference_edges(files: DataFrame) -> DataFrame:
    """Edges from files (path, text, functions) to the files that define a function they call, private names and own definitions left out."""
    files = files.select(texts.safe_key(F.col("path")).alias("key"), "text", "functions")
    defined = files.select(F.col("key").alias("dst"), F.explode("functions").alias("name")).where(~F.col("name").startswith("_")).distinct()
    called = files.select(F.col("key").alias("src"), F.explode(texts.called_names(F.col("text"))).alias("name"))
    own = defined.select(F.col("dst").alias("src"), "name")
    rows = called.join(own, ["src", "name"], "left_anti").join(defined, "name").where("src <> dst")
    return rows.select("src", "dst", F.lit("references").alias("kind"), F.lit(0.8).alias("weight"), "name").distinct()


def capped(edges: DataFrame, fanout: int, *first: Column) -> DataFrame:
    """The first edges (src, dst, weight) of each source: by `first`, then weight, then target; n is their place."""
    return edges.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy(*first, F.desc("weight"), "dst"))).where(F.col("n") <= fanout)


def memory_edges(relationships: DataFrame, reflections: DataFrame) -> DataFrame:
    """(src, dst, weight, pattern): active relationships, then active reflections back-linked from what they consolidate."""
    direct = relationships.where("status = 'active'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("strength").alias("weight"), F.lit(1).alias("pattern"))
    back = reflections.where("status = 'active'").select(F.explode("consolidates").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"), F.lit(2).alias("pattern"))
    return direct.unionByName(back)


def start(seeds: DataFrame, beam: int) -> DataFrame:
    """The first beam from (query_id, id, score)."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return seeds.select("query_id", F.array("id").alias("path"), F.col("id").alias("tail"), F.round("score", 6).alias("score"), rank.alias("rank")).where(F.col("rank") <= beam)


def memory_hop(beams: DataFrame, edges: DataFrame, vertices: DataFrame, queries: DataFrame, size: int, as_of: float, least: float = 0.3, hop: int = 0) -> DataFrame:
    """One hop of beams (query_id, told, beam: array of rank, path, tail, score): 0.6 path + 0.3 diversity + 0.1 recency, cycles left out,
    dead ends kept, and the old beam where no score reaches `least`. told: reasons, to which this hop adds its own, until coverage is reached.

    edges are capped (src, dst, n); vertices (id, embedding, created_at_unix); queries (query_id, q). A query's candidates, at most
    size * fanout, are one array; diversity compares each with the ones before it.
    """
    found = beams.select("query_id", "told", F.inline("beam")).join(edges.select(F.col("src").alias("tail"), "dst", "n"), "tail", "left")
    found = found.join(vertices.select(F.col("id").alias("dst"), "embedding", "created_at_unix"), "dst", "left")
    known = F.col("created_at_unix").isNotNull() | F.col("dst").isNull()  # edges to what isn't there lead nowhere
    row = F.struct("rank", F.coalesce("n", F.lit(0)).alias("n"), "path", "tail", "score", F.when(known, F.col("dst")).alias("dst"), "embedding", "created_at_unix", (~known | F.coalesce(F.array_contains("path", F.col("dst")), F.lit(False))).alias("closed"))
    rows = found.groupBy("query_id", "told").agg(F.array_sort(F.collect_list(row)).alias("all")).join(queries.select("query_id", "q"), "query_id")
    new = F.filter("all", lambda x: ~x["closed"] & x["dst"].isNotNull())
    dead = F.filter("all", lambda x: ~x["closed"] & x["dst"].isNull())

    def scored(x: Column, i: Column) -> Column:
        before = F.filter(F.slice(F.col("new"), F.lit(1), i), lambda y: y["embedding"].isNotNull())
        closest = F.array_max(F.transform(before, lambda y: cosine(x["embedding"], y["embedding"])))
        spread = F.when(x["embedding"].isNull() | F.col("q").isNull(), F.lit(0.5)).otherwise(diversity(cosine(x["embedding"], F.col("q")), closest))
        score = F.round(0.6 * x["score"] + 0.3 * spread + 0.1 * recency((F.lit(as_of) - x["created_at_unix"]) / 86400), 6)
        return F.struct((-score).alias("by"), x["rank"].alias("rank"), x["n"].alias("n"), F.concat(x["path"], F.array(x["dst"])).alias("path"), x["dst"].alias("tail"), score.alias("score"))

    kept = F.transform("dead", lambda x: F.struct((-x["score"]).alias("by"), x["rank"].alias("rank"), x["n"].alias("n"), x["path"].alias("path"), x["tail"].alias("tail"), x["score"].alias("score")))
    rows = rows.select("query_id", "told", "q", "all", new.alias("new"), dead.alias("dead"))
    rows = rows.select("query_id", "told", "all", (F.size("new") + F.size("dead") > size).alias("more"), F.slice(F.array_sort(F.concat(F.transform("new", scored), kept)), 1, size).alias("next"))
    beam = lambda x, rank: F.struct(rank.alias("rank"), x["path"].alias("path"), x["tail"].alias("tail"), x["score"].alias("score"))
    old = F.array_distinct(F.transform("all", lambda x: beam(x, x["rank"])))
    good = F.coalesce(F.array_max(F.transform("next", lambda x: x["score"])) >= least, F.lit(False))
    told = F.concat("told", F.array_compact(F.array(F.when(F.col("more"), f"cap_exceeded_hop_{hop}"), F.when(~good, "coverage_reached"))))
    told = F.when(F.array_contains("told", "coverage_reached"), F.col("told")).otherwise(told)
    return rows.select("query_id", told.alias("told"), F.when(good, F.transform("next", lambda x, i: beam(x, i + 1))).otherwise(old).alias("beam"))


def memory_beams(seeds: DataFrame, edges: DataFrame, vertices: DataFrame, queries: DataFrame, hops: int = 2, fanout: int = 3, size: int = 8, as_of: float = 0.0) -> DataFrame:
    """(query_id, told, beam) after so many hops; all hops are one plan. Queries without seeds aren't in it."""
    near = capped(edges, fanout, F.col("pattern"))
    none = F.array().cast("array<string>")
    counts = seeds.groupBy("query_id").agg((F.count(F.lit(1)) > size).alias("more"))
    beams = start(seeds, size).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "tail", "score"))).alias("beam"))
    beams = beams.join(counts, "query_id").select("query_id", F.when(F.col("more"), F.array(F.lit("cap_exceeded_initial"))).otherwise(none).alias("told"), "beam")
    for hop in range(hops):
        beams = memory_hop(beams, near, vertices, queries, size, as_of, hop=hop)
    return beams


def memory_beam(*args: object, **options: object) -> DataFrame:
    """(query_id, rank, path, tail, score) of memory_beams()."""
    return memory_beams(*args, **options).select("query_id", F.inline("beam"))


def reasons(beams: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, reasons, paths): why the beams (query_id, told, beam) of queries (query_id) are as they are; a query that isn't there had no seeds."""
    rows = queries.select("query_id").join(beams, "query_id", "left")
    return rows.select("query_id", F.coalesce("told", F.array(F.lit("empty_seeds"))).alias("reasons"), F.coalesce(F.size("beam"), F.lit(0)).alias("paths"))


def code_hop(beam: DataFrame, edges: DataFrame, vertices: DataFrame, hop: int, cycles: bool = True) -> DataFrame:
    """Extensions of (query_id, rank, path, tail, seed, score, words, vectors): max(0, 0.6 seed + 0.3 weight + 0.1 overlap - 0.05 hop - 0.2 closest).

    The seed's score and the last edge count, so scores don't add up along a path. Paths without neighbours stay. cycles: whether a path may return.
    """
    found = beam.join(edges.select(F.col("src").alias("tail"), "dst", "weight", "n"), "tail", "left")
    dead = found.where("dst is null").withColumn("n", F.lit(0)).drop("dst", "weight")
    new = found.where("dst is not null")
    new = new if cycles else new.where(~F.array_contains("path", F.col("dst")))
    new = new.join(vertices.select(F.col("id").alias("dst"), "embedding", "content"), "dst")
    # the six digits of score and weight often leave a half at the seventh, so what is added up is rounded in one way alone: a vector is
    # as close as 1 to itself, a tenth of the overlap is one of tenths, and the sum is rounded as a whole number
    near = lambda v: F.when((v == F.col("embedding")) & (norm(v) > 0), F.lit(1.0)).otherwise(cosine(v, F.col("embedding")))
    closest = F.array_max(F.transform("vectors", near))
    redundancy = F.when(F.col("embedding").isNull(), F.lit(0.0)).otherwise(F.coalesce(closest, F.lit(0.0)))
    overlap = texts.keyword_overlap(F.col("words"), F.col("content"), 10)
    score = F.greatest(F.lit(0.0), 0.6 * F.col("seed") + 0.3 * F.coalesce("weight", F.lit(0.5)) + overlap - 0.05 * hop - 0.2 * redundancy)
    vectors = F.when(F.col("embedding").isNull(), F.col("vectors")).otherwise(F.concat("vectors", F.array("embedding")))
    new = new.select("query_id", "rank", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("tail"), "seed", (F.round(score * 1e6) / 1e6).alias("score"), "words", vectors.alias("vectors"), "n")
    return new.unionByName(dead.select(*new.columns))


def cut(paths: DataFrame, size: int) -> DataFrame:
    rows = paths.withColumn("next", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rank", "n"))).where(F.col("next") <= size)
    return rows.withColumn("rank", F.col("next")).drop("next", "n")


def diverse(paths: DataFrame, queries: DataFrame, size: int, weight: float = 0.4) -> DataFrame:
    """Greedy choice of `size` paths a query: the best score first, then by diversity of the ends; a query's paths (beam * fanout) are one group."""
    out = paths.drop("n").schema
    ends = paths.join(queries.select("query_id", "q"), "query_id")

    def pick(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["score", "rank", "n"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        if len(t) > size:
            unit = lambda v: np.array(v) / max(float(np.linalg.norm(v)), 1e-300)
            ends = [unit(v[-1]) if v is not None and len(v) else None for v in t["vectors"]]
            q = unit(t["q"][0])
            chosen, rest = [0], list(range(1, len(t)))
            while rest and len(chosen) < size:
                taken = [ends[i] for i in chosen if ends[i] is not None]
                scored = [(weight * float(ends[i] @ q) - (1 - weight) * max(float(ends[i] @ x) for x in taken) if taken else float(ends[i] @ q), -i) for i in rest if ends[i] is not None]
                if not scored:
                    break
                best = -max(scored)[1]
                chosen.append(best)
                rest.remove(best)
            t = t.iloc[chosen]
        t["rank"] = np.arange(1, len(t) + 1)
        return t[[f.name for f in out]]

    return ends.groupBy("query_id").applyInPandas(pick, out)


def code_beam(seeds: DataFrame, edges: DataFrame, vertices: DataFrame, queries: DataFrame, hops: int = 2, fanout: int = 3, size: int = 8, mmr: bool = False, cycles: bool = True) -> DataFrame:
    """Paths from (query_id, id, score) seeds; queries (query_id, q, words). mmr: prune by diversity instead of by score."""
    first = seeds.join(vertices.select("id", "embedding"), "id").join(queries.select("query_id", "words"), "query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    vectors = F.when(F.col("embedding").isNull(), F.array().cast("array<array<double>>")).otherwise(F.array("embedding"))
    beam = first.select("query_id", rank.alias("rank"), F.array("id").alias("path"), F.col("id").alias("tail"), F.col("score").alias("seed"), "score", "words", vectors.alias("vectors"))
    near = saved(capped(edges, fanout))
    for hop in range(hops):
        paths = code_hop(beam, near, vertices, hop, cycles)
        beam = saved(diverse(paths, queries, size) if mmr else cut(paths, size))
    return cut(beam.withColumn("n", F.lit(0)), size)


def reached(beam: DataFrame) -> DataFrame:
    """(query_id, id, score, place): each vertex of the ranked paths once, with its first path's score."""
    rows = beam.select("query_id", "rank", "score", F.posexplode("path").alias("pos", "id"))
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id", "id").orderBy("rank", "pos"))).where("n = 1")
    return first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "pos"))).select("query_id", "id", "score", "place")


def packed(docs: DataFrame, top: int = 5, preview: int = 600) -> DataFrame:
    """(query_id, context): the first documents (query_id, place, content) as numbered previews."""
    line = F.concat(F.lit("["), F.col("place"), F.lit("] "), F.replace(F.substring("content", 1, preview), F.lit("\n"), F.lit(" ")))
    rows = docs.where(F.col("place") <= top).select("query_id", F.struct("place", line.alias("line")).alias("x"))
    return rows.groupBy("query_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])).alias("context"))




def counters(beam: DataFrame) -> DataFrame:
    """Vertices and edges of a beam's paths, over all of them."""
    return beam.agg(F.coalesce(F.sum(F.size("path")), F.lit(0)).cast("long").alias("nodes"), F.coalesce(F.sum(F.size("path") - 1), F.lit(0)).cast("long").alias("edges"))


def visits(beams: list[DataFrame], near: DataFrame) -> DataFrame:
    """(hop, nodes_visited, edges_traversed): what each hop from these beams (tail) looks at through capped edges; seeds count as visited."""
    out = None
    for hop, beam in enumerate(beams):
        edges = beam.join(near.select(F.col("src").alias("tail"), "dst"), "tail").agg(F.count(F.lit(1)).alias("edges_traversed"))
        if hop:
            rows = edges.select(F.lit(hop).alias("hop"), F.col("edges_traversed").alias("nodes_visited"), "edges_traversed")
        else:
            seeds = beam.agg(F.count(F.lit(1)).alias("seeds"))  # one row each
            rows = edges.crossJoin(seeds).select(F.lit(hop).alias("hop"), (F.col("edges_traversed") + F.col("seeds")).alias("nodes_visited"), "edges_traversed")
        out = rows if out is None else out.unionByName(rows)
    return out


def halved(edges: DataFrame, fanout: int) -> DataFrame:
    """The neighbours that are looked at when time is short: half of the fan-out, one at least."""
    return capped(edges, max(1, fanout // 2))


def breadth_first(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "outbound", prune: Column | None = None) -> DataFrame:
    """(seed, id, depth, parent) of all vertices within `hops` edges of seeds (seed, id), each once for a seed, at its least depth.

    direction: outbound, inbound or any of edges (src, dst). prune: a condition over id and depth; vertices that meet it are found, and not
    gone on from. Of several parents the least is named. Each level joins the edges with the last level's vertices alone, and takes off
    what the seed has visited. A seed whose only way out is one neighbour reaches, one edge later, what that neighbour reaches without the
    seed: such neighbours are walked from once for all of their seeds, so only the result has a row for each seed.
    """
    steps = {"outbound": [("src", "dst")], "inbound": [("dst", "src")], "any": [("src", "dst"), ("dst", "src")]}[direction]
    ways = reduce(DataFrame.unionByName, [edges.select(F.col(a).alias("id"), F.col(b).alias("next")) for a, b in steps])
    kind = edges.schema["src"].dataType
    front = saved(seeds.select("seed", "id", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")).dropDuplicates(["seed", "id"]))
    open_ = front if prune is None else front.where(~F.coalesce(prune, F.lit(False)))
    ends = front.groupBy("seed").agg(F.count(F.lit(1)).alias("ids")).where("ids = 1").select("seed")
    lone = ways.join(open_.select("seed", "id"), "id").where("not (next <=> id)").groupBy("seed", "id").agg(F.min("next").alias("via"), F.max("next").alias("last"), F.max(F.col("next").isNull()).alias("none"))
    lone = saved(lone.where("via = last and not none").join(ends, "seed", "left_semi").select("seed", "id", "via").where(F.lit(hops > 0)))
    if lone.isEmpty():
        return _levels(ways, front, hops, prune)
    others = _levels(ways, front.join(lone.select("seed"), "seed", "left_anti"), hops, prune)
    starts = lone.select(F.col("via").alias("seed"), F.col("via").alias("id"), F.lit(1).alias("depth"), F.lit(None).cast(kind).alias("parent")).distinct()
    shared = _levels(ways, saved(starts), hops, prune, 1).withColumnRenamed("seed", "via")
    # seeds of one neighbour meet its vertices in as many parts as the session has shuffle partitions
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = shared.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    own = lone.select("seed", F.col("id").alias("_own"), "via", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"))
    rows = shared.join(own, ["via", "_part"]).where("not (id <=> _own)")
    rows = rows.select("seed", "id", "depth", F.when(F.col("depth") == 1, F.col("_own")).otherwise(F.col("parent")).alias("parent"))
    return front.join(lone.select("seed"), "seed", "left_semi").select(*rows.columns).unionByName(rows).unionByName(others)


def _levels(ways: DataFrame, front: DataFrame, hops: int, prune: Column | None, first: int = 0) -> DataFrame:
    """The levels from `front` on, whose vertices have the depth `first`."""
    levels = [front]
    for depth in range(first + 1, hops + 1):
        open_ = front if prune is None else front.where(~F.coalesce(prune, F.lit(False)))
        new = ways.join(open_.select("seed", "id"), "id").groupBy("seed", F.col("next").alias("id")).agg(F.min("id").alias("parent"))
        for level in levels:
            new = new.join(level.select("seed", "id"), ["seed", "id"], "left_anti")
        front = saved(new.select("seed", "id", F.lit(depth).alias("depth"), "parent"))
        if front.isEmpty():
            break
        levels.append(front)
    return reduce(DataFrame.unionByName, levels)
