import numpy as np
import pytest
from pyspark.sql import functions as F

from memgrid.functions import scores, texts, times
from memgrid.functions.vectors import cosine, diversity, normalized
from memgrid.operators import graph, memory
from memgrid.operators.chunks import windows
from memgrid.operators.knn import closest, nearest, nearest_of
from memgrid.sources import files, symbols


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_cosine_guards(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    assert [round(r["s"], 4) for r in rows.select(cosine(F.col("a"), F.col("b")).alias("s")).collect()] == [0.7071, 0.0, 0.0, 0.0]
    assert one(spark, normalized(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]


def test_diversity(spark):
    assert one(spark, diversity(F.lit(0.5), F.lit(None).cast("double"))) == 0.5
    assert one(spark, diversity(F.lit(0.5), F.lit(None).cast("double"), first_scaled=True)) == pytest.approx(0.2)
    assert one(spark, diversity(F.lit(0.5), F.lit(1.0))) == pytest.approx(-0.4)


def test_keywords(spark):
    assert one(spark, texts.keyword_overlap(F.lit("How does the beam search work"), F.lit("beam search over edges"))) == 0.4
    assert one(spark, texts.keyword_overlap(F.lit("a of"), F.lit("x"))) == 0.0


@pytest.mark.parametrize(("path", "key"), [("core/a b.py", "core_a_b.py"), ("///", "item"), ("._x_.", "x")])
def test_safe_key(spark, path, key):
    assert one(spark, texts.safe_key(F.lit(path))) == key


def test_long_key_ends_in_hash(spark):
    key = one(spark, texts.safe_key(F.lit("a" * 300)))
    assert len(key) == 254 and key[243] == "_"


@pytest.mark.parametrize(
    ("statement", "path", "key"),
    [
        ("from core.embedders.base import X", "a/b.py", "core_embedders_base.py"),
        ("import requests", "a/b.py", None),
        ("from . import y", "core/a/b.py", "core_a___init__.py"),
        ("from ..c import y", "core/a/b.py", "core_c.py"),
        ("from .c.d import y", "core/a/b.py", "core_a_c.d.py"),
        ("x = 1", "a.py", None),
    ],
)
def test_import_key(spark, statement, path, key):
    assert one(spark, texts.import_key(F.lit(statement), F.lit(path))) == key


def test_chunk_windows(spark):
    rows = spark.createDataFrame([(1, " ".join(map(str, range(1000)))), (2, ""), (3, None)], "id long, text string")
    assert [(r["start_token"], r["end_token"]) for r in windows(rows, "id", "text").orderBy("chunk_index").collect()] == [(0, 512), (384, 896), (768, 1000)]
    rows = spark.createDataFrame([(1, " ".join(["x"] * 1024))], "id long, text string")
    assert [(r["start_token"], r["end_token"]) for r in windows(rows, "id", "text", 1024, 256).orderBy("chunk_index").collect()] == [(0, 1024), (768, 1024)]


def test_pair_score(spark):
    value = one(spark, scores.pair_score(F.lit(2.1375), F.lit(1.53), F.lit(0.8375), F.lit(0.95), F.lit(1.7)))
    assert value["gate"] is None and value["pair"] == pytest.approx(1.783436 * 0.8375**1.7 * 0.95, rel=1e-5)
    assert one(spark, scores.pair_score(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.5), F.lit(1.7)))["gate"] == "context_or_link"
    with pytest.raises(Exception, match="alpha"):
        one(spark, scores.pair_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(3.0)))


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "g string, v double")
    r = memory.nearest_rank(rows, "g", "v").first()
    assert (r["p50"], r["p95"], r["p99"]) == (5.0, 10.0, 10.0)


def test_rolling_context(spark):
    rows = spark.createDataFrame([(1, 1, 80), (1, 2, 40), (1, 3, 30), (2, 1, None)], "session_id long, turn_index long, tokens long")
    assert sorted((r["session_id"], r["turn_index"]) for r in memory.rolling_context(rows, 5, 100).collect()) == [(1, 2), (1, 3), (2, 1)]


def test_upsert_policies(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, "y")], "k string, v int, w string")
    got = {p: sorted((r["k"], r["v"], r["w"]) for r in memory.upserted(old, new, "k", p).collect()) for p in ("ignore", "replace", "update")}
    assert got["ignore"] == [("a", 1, None), ("b", 2, "x"), ("c", 4, "y")]
    assert got["replace"] == [("a", 1, None), ("b", 3, None), ("c", 4, "y")]
    assert got["update"] == [("a", 1, None), ("b", 3, "x"), ("c", 4, "y")]
    with pytest.raises(Exception, match="duplicate key"):
        memory.upserted(old, new, "k", "error").collect()


def test_nearest_in_blocks_equals_one_block(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<double>")
    a = sorted(map(tuple, nearest(rows, "id", "v", 3).collect()))
    assert a == sorted(map(tuple, nearest(rows, "id", "v", 3, block=13).collect())) and len(a) == 180


def test_beam_keeps_dead_ends_and_drops_cycles(spark):
    seeds = spark.createDataFrame([(1, "a", 0.9), (1, "d", 0.5)], "query_id int, id string, score double")
    edges = spark.createDataFrame([("a", "b", 1.0, 1), ("b", "a", 1.0, 1)], "src string, dst string, weight double, pattern int")
    vertices = spark.createDataFrame([(x, [1.0, 0.0], 0.0) for x in "abd"], "id string, embedding array<double>, created_at_unix double")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>")
    paths = {tuple(r["path"]) for r in graph.memory_beam(seeds, edges, vertices, queries, hops=1).collect()}
    assert paths == {("a", "b"), ("d",)}
    assert {tuple(r["path"]) for r in graph.memory_beam(seeds, edges, vertices, queries, hops=2).collect()} == {("d",)}


def test_time_words():
    at = 10 * 86400 + 3600
    assert times.since("today", at) == 10 * 86400 and times.since("yesterday", at) == 9 * 86400
    assert times.since("last 2 days", at) == at - 2 * 86400 and times.since("someday", at) is None


def test_files(spark, tmp_path):
    for name in ("a.py", "sub/b.py", ".hidden/c.py", "skip/d.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = files.files(spark, str(tmp_path), "*.py", ["# no", "skip/"])
    assert sorted(r["path"] for r in rows.collect()) == ["a.py", "sub/b.py"]


def test_symbols():
    assert ("constant", "LIMIT", 1, "") in symbols.symbols_of("LIMIT = 3\n", "python")
    assert symbols.symbols_of("def (", "python") == []


def test_surprise_chunks_make_up_the_text(spark):
    from memgrid.operators import surprise

    rows = spark.createDataFrame([(1, "the and the and the and the and zebra and the and the " * 9)], "id long, text string")
    cuts = surprise.boundaries(surprise.scored_words(rows, "id", "text"), "id", least=40)
    parts = [r["chunk"] for r in surprise.chunks(rows, cuts, "id", "text").orderBy("n").collect()]
    assert len(parts) > 2 and "".join(parts) == rows.first()["text"]


def test_surprise_chunks_of_whole_documents(spark):
    import math
    from collections import Counter

    import numpy as np

    from compare import DATA
    from memgrid import plans

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    counts = Counter(w for x in texts.values() for w in (x or "").split(" ") if w)
    total = sum(counts.values())
    want = {}
    for key, text in texts.items():
        words, at = [], 0
        for w in (text or "").split(" "):
            if w:
                words.append((at, -math.log(counts[w] / total)))
            at += len(w) + 1
        if not words:
            continue
        limit = np.percentile([s for _, s in words], 85)
        cuts = [0]
        for at, s in words:
            if s > limit + 1e-12 and at - cuts[-1] >= 100:
                cuts.append(at)
        for n, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(text)], strict=True)):
            near = [s for at, s in words if a - 100 <= at < a + 100]
            want[key, n] = (a, text[a:z], round(sum(near) / len(near), 6) if near else 0.0)
    got = {(r["doc_id"], r["n"]): (r["start"], r["chunk"], round(r["surprise"], 6)) for r in plans.queries()["surprise_chunks"](spark, DATA).collect()}
    assert max(n for _, n in want) > 10
    assert got.keys() == want.keys()
    for k, (a, chunk, mean) in want.items():
        assert got[k][:2] == (a, chunk) and abs(got[k][2] - mean) < 2e-6


@pytest.mark.parametrize("head", [1, 20_000])
def test_surprise_puts_out_no_row_for_a_place(spark, monkeypatch, head):
    from memgrid.operators import surprise

    written = []
    saved = surprise.saved
    monkeypatch.setattr(surprise, "saved", lambda df: written.append(saved(df)) or written[-1])
    monkeypatch.setattr(surprise, "HEAD", head)
    monkeypatch.setattr(surprise.often, "__defaults__", (head,))
    text = ("the and\u00a0b " + "the and " * 12 + "zebra  \u00e9\U0001f600 ") * 40
    rows = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, text + " end"), (None, "lone")], "id long, text string")
    scores = surprise.scored_words(rows, "id", "text")
    cuts = surprise.boundaries(scores, "id", least=40)
    near = surprise.around(scores, cuts, "id")
    want = surprise.chunks(rows, cuts, "id", "text").join(near, ["id", "start"], "left").collect()
    written.clear()
    got = [r for r in surprise.cut_chunks(rows, "id", "text", least=40).collect() if r["id"] is not None]
    key = lambda r: (r["id"], r["n"], r["start"], r["chunk"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 8
    assert sorted(r["surprise"] for r in got) == pytest.approx(sorted(r["surprise"] for r in want))
    means = {r["id"]: r["mean"] for r in surprise.surprising(rows, "id", "text").collect()}
    assert means.keys() == {1, 4, None} and means[None] == pytest.approx(np.log(2242))
    assert sum(w.count() for w in written) < 40  # words, not places


def test_texts_as_files_where_arrow_cannot_write(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from memgrid.sources import sinks

    def from_uri(_):
        raise ValueError

    monkeypatch.setattr(sinks, "fs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=from_uri)))
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "name string, text string")
    sinks.write_texts(rows, str(tmp_path / "f"))
    assert sorted(bytes(r["content"]) for r in files.files(spark, str(tmp_path / "f"), "*.txt").collect()) == [b"x\0", b"y\0", b"z\0"]


def test_texts_as_files_without_folders_of_their_own(spark, tmp_path):
    from memgrid.sources import sinks

    rows = spark.createDataFrame([("a", "x\u00e9\n"), ("b", ""), ("a", "two"), (None, "three"), ("c d/e", "y\x00")] + [(f"n{k}", str(k)) for k in range(100)], "name string, text string")
    for at in (f"{tmp_path}/plain", f"file://{tmp_path}/uri"):
        sinks.write_texts(rows, at)
        found = sorted(r["content"].decode() for r in files.files(spark, at, "*.txt").collect())
        assert found == sorted(r["text"] + "\0" for r in rows.collect())
    assert sum(p.is_dir() for p in (tmp_path / "plain").rglob("*")) <= 9  # not one a file


def test_sinks(spark, tmp_path):
    from memgrid.sources import sinks

    rows = spark.createDataFrame([("a", "b", "k", 1.0), ("a", "b", "k", 1.0)], "src string, dst string, kind string, weight double")
    assert sinks.keyed_edges(rows).count() == 1
    sinks.export_graph(rows.select("src").distinct(), rows, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 2
    sinks.append_json(rows, str(tmp_path / "j"))
    sinks.append_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    turns = spark.createDataFrame([(1, None)], "turn long, tokens long")
    sinks.append_turn(turns, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first()["tokens"] == 0


def test_closest_is_exact_with_copies_and_ties():
    r = np.random.default_rng(1)
    for n, m, copies in ((300, 500, 0), (700, 900, 1), (600, 3, 0), (10, 1, 0)):
        v, w = r.normal(size=(n, 16)), r.normal(size=(m, 16))
        if copies:
            v[: n // 2] = w[: m // 2] = w[0]
            v[-1] = 0
        v, w = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None] for x in (v, w))
        keys, other = r.permutation(1000)[:n], r.permutation(1000)[:m]
        sims = np.round(v @ w.T, 6) + 0.0
        want = [(a, b, -x) for a, row in zip(keys, sims, strict=True) for x, b in sorted((-x, b) for x, b in zip(row, other, strict=True) if a != b)[:3]]
        assert sorted(zip(*closest(keys, v, other, w, 3), strict=True)) == sorted(want)


def test_a_pair_of_blocks_is_one_group(spark):
    rows = spark.range(100).select(F.col("id"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    found = nearest(rows, "id", "v", 3, block=10)  # 10 blocks, 55 pairs
    assert found.count() == 300
    assert "least" in found._jdf.queryExecution().analyzed().toString()


def test_one_vector_asks_all_blocks(spark):
    rows = spark.range(100).select(F.col("id"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    some = F.col("id").isin(7, 93)
    want = sorted(map(tuple, nearest(rows, "id", "v", 3, block=10).where("src in (7, 93)").collect()))
    assert sorted(map(tuple, nearest_of(rows, some, "id", "v", 3, block=9).collect())) == want


def test_extracted_texts_leave_in_bounded_batches(spark):
    rows = spark.createDataFrame([(f"{n}.txt", bytearray(b"x" * 1000)) for n in range(10)], "path string, content binary")
    out = files.extracted(rows)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["path"], len(r["text"])) for r in out.collect()} == {(f"{n}.txt", 1000) for n in range(10)}
