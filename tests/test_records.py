"""Streams over several micro-batches, layers, embeddings, and files that are read badly, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memgrid import plans
from memgrid.functions import embed
from memgrid.operators import learning
from memgrid.plans.records import graph_model
from memgrid.sources import symbols
from memgrid.streaming import streams

DATA = "/root/testdata/sf0.001"


def turns(spark, at, rows):
    spark.createDataFrame(rows, "session_id long, turn_index long, tokens long").coalesce(1).write.mode("append").parquet(at)


def test_rolling_context_over_batches_and_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at, state = str(tmp_path / "in"), str(tmp_path / "state")
    turns(spark, at, [(1, k, 10) for k in range(8)] + [(2, 0, 500)])
    stream = lambda: spark.readStream.schema("session_id long, turn_index long, tokens long").option("maxFilesPerTrigger", 1).parquet(at)
    assert sorted(map(tuple, streams.rolled(stream(), state).collect())) == [(1, k) for k in range(2, 8)]
    turns(spark, at, [(1, 8, 10), (1, 9, None)])
    turns(spark, at, [(2, 1, 5)])
    got = sorted(map(tuple, streams.rolled(stream(), state).collect()))
    assert got == [(1, k) for k in range(4, 10)] + [(2, 1)]


def test_changes_over_batches_and_a_restart(spark, tmp_path):
    at, state = str(tmp_path / "in"), str(tmp_path / "state")
    kind = "key long, seq_no long, op string, payload double"
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(at)
    put([(1, 1, "upsert_node", 1.0), (2, 2, "upsert_node", 2.0)])
    stream = lambda: spark.readStream.schema(kind).parquet(at)
    assert sorted(r["key"] for r in streams.applied(stream(), at=state).collect()) == [1, 2]
    put([(1, 4, "delete_node", None), (2, 1, "upsert_node", 9.0), (3, 5, "upsert_node", 3.0)])
    assert sorted((r["key"], r["payload"]) for r in streams.applied(stream(), at=state).collect()) == [(2, 2.0), (3, 3.0)]


def test_empty_streams(spark, tmp_path):
    at = str(tmp_path / "none")
    spark.createDataFrame([], "key long, seq_no long, op string, payload double").write.parquet(at)
    stream = spark.readStream.schema("key long, seq_no long, op string, payload double").parquet(at)
    assert streams.applied(stream).collect() == []


def plain_graph(features, edges, model):
    ids = sorted(features)
    parts, powers = [], []
    for kind, layers in model["layers"].items():
        into = {i: [a for a, b, k in edges if b == i and k == kind] for i in ids}
        if not any(k == kind for *_, k in edges):
            continue
        h = {i: np.array(features[i]) for i in ids}
        for n, (root, side, bias) in enumerate(layers):
            mean = {i: np.mean([h[a] for a in into[i]], axis=0) if into[i] else np.zeros(len(h[i])) for i in ids}
            h = {i: root @ h[i] + side @ mean[i] + bias for i in ids}
            if n < len(layers) - 1:
                h = {i: np.maximum(x, 0) for i, x in h.items()}
        parts.append(h)
        powers.append(np.exp(model["attention"][kind]))
    if not parts:
        out = {i: model["project"] @ np.array(features[i]) for i in ids}
    else:
        out = {i: sum(w / sum(powers) * h[i] for w, h in zip(powers, parts, strict=True)) for i in ids}
    return {i: x / max(np.linalg.norm(x), 1e-12) for i, x in out.items()}


@pytest.mark.parametrize("kinds", [("relates_to", "conflicts_with"), ("relates_to",), ()])
def test_graph_embeddings(spark, kinds):
    r = np.random.default_rng(1)
    features = {i: r.normal(size=64).tolist() for i in range(12)}
    edges = [(a, b, k) for k in kinds for a, b in r.integers(0, 12, (15, 2)).tolist()]
    own = spark.createDataFrame(list(features.items()), "id long, v array<double>")
    rows = spark.createDataFrame(edges, "src long, dst long, kind string")
    want = plain_graph(features, edges, graph_model())
    got = {x["id"]: x["v"] for x in learning.embedded(own, rows, **graph_model()).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i].tolist(), abs=1e-9) for i in want)


def test_new_nodes_agree_with_the_whole_graph(spark):
    q = plans.queries()
    whole = {r["id"]: r["v"] for r in q["graph_embeddings"](spark, DATA).collect()}
    some = {r["id"]: r["v"] for r in q["new_node_embeddings"](spark, DATA).collect()}
    assert some and all(some[i] == pytest.approx(whole[i], abs=2e-6) for i in some)


def test_model_hook(spark):
    seen = []

    def model(batch):
        return np.array([[len(x), x.count("a"), 0.0] for x in batch])

    rows = spark.createDataFrame([(1, "banana"), (2, ""), (3, None), (4, "kiwi")], "k long, t string")
    got = {r["k"]: list(r["embedding"]) for r in embed.embedded(rows, "k", "t", model, 3, batch=2, task="passage").collect()}
    assert got[2] == got[3] == [0, 0, 0] and got[1] == pytest.approx([15 / np.hypot(15, 5), 5 / np.hypot(15, 5), 0], abs=1e-6)
    assert not seen and np.linalg.norm(got[4]) == pytest.approx(1, abs=1e-6)


def test_deep_sources_do_not_end_the_job(spark):
    deep = "x = " + "(" * 5000 + ")" * 5000
    nested = "\n".join("    " * k + f"def f{k}():" for k in range(90)) + "\n" + "    " * 90 + "pass"
    rows = spark.createDataFrame([("a.py", deep, "python"), ("b.py", "-" * 100_000 + "1", "python"), ("c.py", nested, "python"), ("d.py", "def f(): pass", "python")], "path string, text string, language string")
    assert "d.py" in {r["path"] for r in symbols.symbols(rows).collect()}
    assert {r["path"] for r in symbols.structure(rows).collect()} >= {"d.py"}
    assert symbols.config_metrics(rows.withColumn("text", F.lit("[" * 100_000))).where("valid").count() == 0


def test_cells_find_most_neighbours(spark):
    """Recall of the inverted file against the exact neighbours, for the queries that are asked."""
    at = "/root/testdata/sf0.01"
    got = {(r["src"], r["dst"]) for r in plans.queries()["cell_neighbours"](spark, at).collect()}
    want = {(r["src"], r["dst"]) for r in plans.queries()["knn_graph"](spark, at).collect() if r["src"] % 20 == 0}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_hot_cells_are_cut(spark):
    from memgrid.operators import knn

    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=(1, 8)) + r.normal(size=(60, 8)) * 0.01, r.normal(size=(40, 8))])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, e array<double>")
    pick = lambda df: sorted((x["src"], x["w"]) for x in df.collect())
    assert pick(knn.near_cells(rows, "k", "e", 2, cells=4, probes=4, block=7)) == pick(knn.nearest(rows, "k", "e", 2))


def test_readers_fall_back_and_are_stopped(spark):
    import time

    from memgrid.sources import files

    def slow(content):
        time.sleep(5)
        return "never"

    def strict(content):
        if not content.startswith(b"ok"):
            raise ValueError("not ok")
        return content.decode()

    rows = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"no")), ("c", None)], "path string, content binary")
    got = {r["path"]: r for r in files.robust(rows, [("slow", slow), ("strict", strict), ("raw", lambda x: x.decode())], 0.2).collect()}
    assert [(got[k]["text"], got[k]["reader"], len(got[k]["errors"])) for k in "abc"] == [("ok", "strict", 1), ("no", "raw", 2), ("", "raw", 2)]
    assert got["b"]["errors"] == ["slow: over 0.2 s", "strict: not ok"]
