"""Training, block surprise and traversal against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memgrid.functions import texts
from memgrid.operators import graph, surprise, training
from memgrid.plans.tables import Tables
from memgrid.plans.walks import training_pairs
from memgrid.sources import stage


def arrays(rows):
    return [np.array([r[c] for r in rows], float) for c in ("q", "v", "m", "label")]


def plain_run(train, valid, outer, s, epochs):
    """The same training by numeric loss and one array."""
    state = training.started(train[0].shape[1], outer, s.rate)
    for _ in range(epochs):
        loss, slope = training.loss_and_gradient(state.weights, *train, outer, s.margin)
        training.stepped(state, slope / len(train[0]), s)
        held, _ = training.loss_and_gradient(state.weights, *valid, outer, s.margin)
        training.noted(state, loss / len(train[0]), held / len(valid[0]), s)
    return state


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(2)
    q, v, m, label = r.normal(size=(30, 5)), r.normal(size=(30, 5)), r.normal(size=(30, 5)), r.integers(0, 2, 30)
    w = training.started(5, 3, 0.1).weights
    _, slope = training.loss_and_gradient(w, q, v, m, label, 3, 0.1)
    for k in range(0, len(w), 4):
        step = np.zeros(len(w))
        step[k] = 1e-6
        up, down = (training.loss_and_gradient(w + x, q, v, m, label, 3, 0.1)[0] for x in (step, -step))
        assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_losses_equal_a_plain_run_and_go_on_after_a_stop(spark, tmp_path, monkeypatch):
    pairs = training_pairs(Tables(spark, "/root/testdata/sf0.001")).cache()
    held = F.col("id") % 5 == 0
    train, valid = pairs.where(~held).repartition(9), pairs.where(held)
    s = training.Settings(epochs=7)
    monkeypatch.setattr(training, "FAN", 2)
    training.trained(train, valid, 64, 8, training.Settings(epochs=3), str(tmp_path))
    state = training.trained(train, valid, 64, 8, s, str(tmp_path))
    want = plain_run(arrays(train.collect()), arrays(valid.collect()), 8, s, 7)
    assert state.train_losses == pytest.approx(want.train_losses, abs=1e-9) and state.valid_losses == pytest.approx(want.valid_losses, abs=1e-9)
    assert state.train_losses[-1] < state.train_losses[0]
    assert training.resumed(spark, str(tmp_path), 3).train_losses == pytest.approx(want.train_losses[:3], abs=1e-9)
    assert training.trained(train, valid, 64, 8, s, str(tmp_path)).epoch == 7


def test_rate_falls_and_training_ends_where_it_is_stuck():
    s = training.Settings(plateau=2, patience=5)
    state = training.started(4, 2, 1.0)
    for loss in (1.0, 0.9, 0.95, 0.95, 0.95, 0.95, 0.95):
        training.noted(state, 0.0, loss, s)
    assert state.best_epoch == 2 and state.bad == 5 and state.rate == 0.5 and state.rates == [1.0] * 5 + [0.5] * 2


def test_block_scores_equal_a_plain_model(spark, monkeypatch):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 24, 25, 26, 51, 200])))) for i in range(30)] + [(99, None), (98, "  ")]
    docs += [(50 + i, " ".join(["a b"] * 12 + [f"once{i} then{i % 2}"] + ["c", "d" if i % 2 else f"last{i}"] * 12 + ["only", "one"] * 13)) for i in range(6)]
    docs += [(60 + i, " ".join(["b"] * 24 + [f"x{i}", f"y{i}", "b", f"y{i}", f"x{i}"] + ["b"] * 20 + [f"z{i}"] * 30)) for i in range(3)]
    rows = spark.createDataFrame(docs, "id long, text string")
    words = texts.window_words(F.col("text"))
    got = {(x["id"], x["at"]): x["score"] for x in surprise.block_scores(surprise.blocks(rows, "id", words), "id", surprise.BackOff(rows, words)).collect()}
    pairs, uni, last = Counter(), Counter(), defaultdict(set)
    for _, t in docs:
        own = (t or "").split()
        uni.update(own)
        for a, b in zip(own, own[1:], strict=False):
            pairs[a, b] += 1
            last[a].add(b)
    after = Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    want = {}
    for i, t in docs:
        own = (t or "").split()
        for k, w in enumerate(own):
            c = own[k // 25 * 25 - 1] if k >= 25 else None
            p = None if c is None else max(pairs[c, w] - 0.5, 0) / after[c] + 0.5 * len(last[c]) / after[c] * uni[w] / uni.total()
            want[i, k] = 0.5 if c is None else -math.log(p + 1e-10)
    assert got == pytest.approx(want)
    scores = defaultdict(list)
    for (i, _), x in want.items():
        scores[i].append(x)
    for pairs_sent, words_sent in ((surprise.PAIRS, surprise.HEAD), (1, 1)):  # all by broadcast, all by shuffles
        monkeypatch.setattr(surprise, "PAIRS", pairs_sent)
        monkeypatch.setattr(surprise, "HEAD", words_sent)
        monkeypatch.setattr(surprise.often, "__defaults__", (words_sent,))
        found = {x["id"]: (x["tokens"], x["surprise"], x["peak"]) for x in surprise.block_summary(rows, "id", "text").collect()}
        assert found.keys() == scores.keys()
        for i, own in scores.items():
            assert found[i] == pytest.approx((len(own), sum(own) / len(own), max(own)))


def test_rare_words_and_stored_pairs_move_once(spark):
    docs = spark.createDataFrame([(None, "a b c"), (2, "b c c"), (3, None)], "id long, text string")
    words = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, n long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = surprise.with_rare(docs, "id", "text", str.split, words, spark.sparkContext.broadcast({"b": ()}), 3)
        # asked words, the table, what is found, and the texts
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        assert {r["id"]: sorted(r["rare"]["n"] or []) for r in rows.collect()} == {None: [1, 3], 2: [3], 3: []}
        kept = stage.bucketed(words, "word")
        joined = words.join(kept, "word", "left")
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and joined.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_blocks_have_their_context_and_any_model_may_score_them(spark):
    rows = surprise.blocks(spark.createDataFrame([(1, " ".join(map(str, range(130)))), (2, "")], "id long, text string"), "id", texts.window_words(F.col("text")))
    found = {x["block"]: (x["context"], x["targets"]) for x in rows.collect()}
    assert len(found) == 6 and found[0][0] == [] and found[1][0] == [str(n) for n in range(25)] and found[4][0] == [str(n) for n in range(50, 100)] and found[5][1] == [str(n) for n in range(125, 130)]
    scores = {x["at"]: x["score"] for x in surprise.scored_by(rows, "id", lambda c, t: [[0.5 if x == "77" else 1.0 for x in own] for own in t], batch=2).collect()}
    assert len(scores) == 130 and scores[3] == 0.5 and scores[77] == pytest.approx(math.log(2), abs=1e-6) and scores[78] == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("direction", ["outbound", "inbound", "any"])
def test_breadth_first_equals_a_plain_walk(spark, direction):
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(110)]
    ways = [(a, b) for a, b in edges if direction != "inbound"] + [(b, a) for a, b in edges if direction != "outbound"]
    want = {}
    for seed in (1, 2, 3):
        level = {seed: None}
        seen = dict.fromkeys([seed], (0, None))
        for depth in range(1, 4):
            new = {}
            for a, b in ways:
                if a in level and a % 7 and b not in seen:
                    new[b] = min(new.get(b, a), a)
            seen |= {b: (depth, p) for b, p in new.items()}
            level = new
        want |= {(seed, v): x for v, x in seen.items()}
    rows = graph.breadth_first(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(s, s) for s in (1, 2, 3)], "seed long, id long"), 3, direction, F.col("id") % 7 == 0)
    assert {(x["seed"], x["id"]): (x["depth"], x["parent"]) for x in rows.collect()} == want


@pytest.mark.parametrize("direction", ["outbound", "inbound", "any"])
def test_breadth_first_of_seeds_with_one_way_out(spark, direction):
    r = random.Random(9)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(45)] + [(n, n) for n in range(5)]
    ways = [(a, b) for a, b in edges if direction != "inbound"] + [(b, a) for a, b in edges if direction != "outbound"]
    seeds = [(n, n) for n in range(40)] + [(100, 1), (100, 2), (101, 3)]
    want = {}
    for seed in {s for s, _ in seeds}:
        level = {v for s, v in seeds if s == seed}
        seen = dict.fromkeys(level, (0, None))
        for depth in range(1, 5):
            new = {}
            for a, b in ways:
                if a in level and not (a % 7 == 0 and depth == 2) and b not in seen:
                    new[b] = min(new.get(b, a), a)
            seen |= {b: (depth, p) for b, p in new.items()}
            level = set(new)
        want |= {(seed, v): x for v, x in seen.items()}
    prune = (F.col("id") % 7 == 0) & (F.col("depth") == 1)
    rows = graph.breadth_first(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(seeds, "seed long, id long"), 4, direction, prune).collect()
    assert len(rows) == len(want)
    assert {(x["seed"], x["id"]): (x["depth"], x["parent"]) for x in rows} == want


def test_breadth_first_walks_once_from_a_shared_neighbour(spark, monkeypatch):
    written = []
    saved = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: written.append(saved(df)) or written[-1])
    edges = spark.range(300).selectExpr("1000L src", "id dst")
    rows = graph.breadth_first(edges, spark.range(200).selectExpr("id seed", "id"), 3, "any")
    assert rows.count() == 200 * 301
    assert sum(x.count() for x in written) < 2000  # not 200 x 300
