"""Invariants of beams, and the greedy choice against a plain version."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from compare import DATA
from memgrid.operators import graph, memory
from memgrid.plans.retrieval import _beam_tables
from memgrid.plans.tables import Tables


def test_memory_beam_invariants(spark):
    t = Tables(spark, DATA)
    seeds, queries, content = _beam_tables(t)
    rows = graph.memory_beam(seeds, graph.memory_edges(t.relationships, t.reflections), content, queries, hops=2, fanout=3, size=4, as_of=1711267200.0).collect()
    firsts = {r["id"] for r in seeds.collect()}
    assert 0 < len(rows) <= 4 and sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    for r in rows:
        assert len(r["path"]) <= 3 and len(set(r["path"])) == len(r["path"]) and r["path"][0] in firsts and r["path"][-1] == r["tail"]


def test_fan_out_is_capped(spark):
    hub = spark.createDataFrame([("hub", f"n{i:03}", i / 100) for i in range(100)], "src string, dst string, weight double")
    got = [r["dst"] for r in graph.capped(hub, 3).orderBy("n").collect()]
    assert got == ["n099", "n098", "n097"]


def test_diverse_choice(spark):
    r = np.random.default_rng(5)
    q = r.normal(size=6)
    paths = [(1, k, [f"v{k}"], f"v{k}", 0.5, float(np.round(r.random(), 3)), "w", [r.normal(size=6).tolist()] if k % 5 else [], 0) for k in range(1, 15)]
    schema = "query_id int, rank int, path array<string>, tail string, seed double, score double, words string, vectors array<array<double>>, n int"
    queries = spark.createDataFrame([(1, q.tolist(), "w")], "query_id int, q array<double>, words string")
    got = [x["tail"] for x in graph.diverse(spark.createDataFrame(paths, schema), queries, 6).orderBy("rank").collect()]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    rest = sorted(paths, key=lambda p: (-p[5], p[1]))
    chosen = [rest.pop(0)]
    while len(chosen) < 6:
        taken = [unit(p[7][-1]) for p in chosen if p[7]]
        scored = [(0.4 * unit(p[7][-1]) @ unit(q) - 0.6 * max(unit(p[7][-1]) @ x for x in taken) if taken else unit(p[7][-1]) @ unit(q), -k) for k, p in enumerate(rest) if p[7]]
        chosen.append(rest.pop(-max(scored)[1]))
    assert got == [p[3] for p in chosen]


def test_words_anywhere_in_a_text_count(spark):
    seeds = spark.createDataFrame([(1, "a", 0.9)], "query_id int, id string, score double")
    rows = [("a", [1.0, 0.0], ""), ("b", [0.0, 1.0], "x" * 5000 + " needle"), ("c", [0.0, 1.0], "needle")]
    vertices = spark.createDataFrame(rows, "id string, embedding array<double>, content string")
    queries = spark.createDataFrame([(1, [1.0, 0.0], "needle")], "query_id int, q array<double>, words string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0)], "src string, dst string, weight double")
    for mmr in (False, True):
        got = {r["tail"]: r["score"] for r in graph.code_beam(seeds, edges, vertices, queries, hops=1, mmr=mmr).collect()}
        assert got == {"b": 0.94, "c": 0.94}


def test_scores_at_a_half_round_as_sql_does(spark):
    seed, weight, n = 0.345179, 0.320677, 3
    beam = spark.createDataFrame([(1, 1, ["a"], "a", seed, seed, "one two three", [[0.6, 0.8]])], "query_id int, rank int, path array<string>, tail string, seed double, score double, words string, vectors array<array<double>>")
    edges = spark.createDataFrame([("a", "b", weight, 1)], "src string, dst string, weight double, n int")
    vertices = spark.createDataFrame([("b", [0.6, 0.8], "one two three")], "id string, embedding array<double>, content string")
    sql = f"select round(greatest(0, 0.6 * {seed}::double + 0.3 * {weight}::double + 0.1 * {n}::bigint / {n}::bigint - 0.05 * 1 - 0.2 * 1::double), 6)"
    assert graph.code_hop(beam, edges, vertices, 1).first()["score"] == duckdb.connect().execute(sql).fetchone()[0] == 0.15331


def test_missing_vectors_and_no_edges(spark):
    seeds = spark.createDataFrame([(1, "a", 0.9)], "query_id int, id string, score double")
    vertices = spark.createDataFrame([("a", None, 0.0), ("b", None, 0.0)], "id string, embedding array<double>, created_at_unix double")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>")
    none = spark.createDataFrame([], "src string, dst string, weight double, pattern int")
    assert [x["path"] for x in graph.memory_beam(seeds, none, vertices, queries).collect()] == [["a"]]
    one = spark.createDataFrame([("a", "b", 1.0, 1)], none.schema)
    best = graph.memory_beam(seeds, one, vertices, queries, hops=1).first()
    assert best["path"] == ["a", "b"] and abs(best["score"] - (0.6 * 0.9 + 0.15 + 0.1)) < 1e-6


def test_packing_numbers_documents(spark):
    rows = spark.createDataFrame([(1, 2, "b\nb"), (1, 1, "a" * 700), (1, 9, "left out")], "query_id int, place int, content string")
    assert graph.packed(rows).first()["context"] == f"[1] {'a' * 600}\n[2] b b"
    assert graph.packed(rows.withColumn("content", F.lit("x"))).count() == 1


def test_reasons_by_hop(spark):
    vertices = spark.createDataFrame([(x, [1.0, i / 50], 0.0) for i, x in enumerate("abcdefghijklmnopqrstuvwxyz")], "id string, embedding array<double>, created_at_unix double")
    edges = spark.createDataFrame([(a, b, 1.0, 1) for a in "abc" for b in "mnopqrst"], "src string, dst string, weight double, pattern int")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])], "query_id int, q array<double>")
    seeds = spark.createDataFrame([(1, x, 0.9) for x in "abcd"] + [(2, "a", 0.9)] + [(3, "a", 0.01), (3, "b", 0.01)], "query_id int, id string, score double")
    beams = graph.memory_beams(seeds, edges, vertices, queries, hops=2, fanout=3, size=3, as_of=86400.0 * 3000)
    got = {r["query_id"]: r["reasons"] for r in graph.reasons(beams, queries).collect()}
    assert got[4] == ["empty_seeds"] and got[1][:2] == ["cap_exceeded_initial", "cap_exceeded_hop_0"]
    assert got[2] == [] and got[3] == ["cap_exceeded_hop_0", "coverage_reached"]


def test_nearest_rank_with_an_outlier(spark):
    rows = [("a", float(n)) for n in range(1000)] + [("a", 1e18), ("b", 5.0), ("b", None), ("c", None)] + [("d", 1.0)] * 50
    got = {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in memory.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {"a": (500.0, 950.0, 990.0), "b": (5.0, 5.0, 5.0), "d": (1.0, 1.0, 1.0)}


def test_nearest_rank_makes_its_ranges_once(spark):
    many = spark.range(0, 200_000, 1, 16).select(F.concat(F.lit("g"), F.col("id") % 2).alias("g"), (F.hash("id") % 100_003 + F.col("id") / 7).alias("v"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        got = {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in memory.nearest_rank(many, "g", "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    values = {g: sorted(r["v"] for r in many.where(F.col("g") == g).collect()) for g in ("g0", "g1")}
    assert got == {g: tuple(v[round((len(v) - 1) * p)] for p in (0.5, 0.95, 0.99)) for g, v in values.items()}


def test_nearest_rank_keeps_a_null_group(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {r["g"]: (r["p50"], r["p99"]) for r in memory.nearest_rank(rows, "g", "v").collect()} == {None: (2.0, 3.0), "a": (5.0, 5.0)}


def test_whole_reflections(spark):
    rows = [("s", "k1", "o/k1", "event", "cats run", ["t", "u", None], 0.0), ("s", "k2", "o/k2", "learning", None, ["t"], 86400.0 * 30), ("s", "k3", "o/k3", "event", "x", ["t", "a"], 86400.0 * 15)]
    obs = spark.createDataFrame(rows, "session_id string, key string, id string, memory_type string, content string, tags array<string>, created_at_unix double")
    found = spark.createDataFrame([("s", "t", 3, ["k2", "k1", "k3"])], "session_id string, tag string, n int, members array<string>")
    r = memory.reflections(found, obs, 86400.0 * 30, lambda p: p, lambda c: F.array(F.length(c)), "Sum up: {observations} .").first()
    assert r["content"] == "Sum up: [1] LEARNING: \n   Tags: t\n\n[2] EVENT: cats run\n   Tags: t, u\n\n[3] EVENT: x\n   Tags: t, a ."
    assert (r["tags"], r["consolidates"], r["strength"], r["prompt_tokens"], r["embedding"]) == (["a", "t", "u"], ["o/k2", "o/k1", "o/k3"], 0.5, 20, [len(r["content"])])
