"""Keyed tables, ingestion, retention, cursors and mentions."""

import glob
import os
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from compare import DATA
from memgrid.operators import entities, paging
from memgrid.plans import stores
from memgrid.plans.tables import Tables
from memgrid.sources import keyed
from memgrid.sources.stage import stored
from memgrid.streaming import streams

SCHEMA = StructType().add("key", "string").add("a", "long").add("b", "string")


def rows_of(table):
    return sorted(tuple(r) for r in table.rows().collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "b string, key string, a int")


@pytest.fixture
def table(spark, tmp_path):
    return keyed.Keyed(spark, str(tmp_path / "t"), "key", SCHEMA, 8)


def test_policies_over_two_writes(spark, table):
    assert table.write(frame(spark, [("x", "k1", 1), ("y", "k2", 2), ("z", "k2", 3)]), "ignore", ["a"]) == keyed.Written(2, 0, 1)
    assert rows_of(table) == [("k1", 1, "x"), ("k2", 2, "y")]
    assert table.write(frame(spark, [("n", "k1", 9), ("n", "k3", 9)]), "ignore") == keyed.Written(1, 0, 1)
    assert table.write(frame(spark, [(None, "k1", 5), ("w", "k2", None), ("v", "k2", 7)]), "update", ["a"]) == keyed.Written(0, 3, 0)
    assert rows_of(table) == [("k1", 5, "x"), ("k2", 7, "v"), ("k3", 9, "n")]
    assert table.write(frame(spark, [(None, "k1", None), ("q", "k4", 1)]), "replace") == keyed.Written(1, 1, 0)
    assert rows_of(table) == [("k1", None, None), ("k2", 7, "v"), ("k3", 9, "n"), ("k4", 1, "q")]
    for clash in ([("q", "k4", 1)], [("q", "k9", 1), ("r", "k9", 2)]):
        with pytest.raises(keyed.DuplicateKey, match="k4|k9"):
            table.write(frame(spark, clash), "error")
    assert table.write(frame(spark, [("e", "k5", 1)]), "error") == keyed.Written(1, 0, 0)
    with pytest.raises(ValueError, match="without"):
        table.write(frame(spark, [("e", None, 1)]))
    assert [r["b"] for r in table.get("k5", "k9").collect()] == ["e"]
    assert table.write(frame(spark, []), "replace") == keyed.Written(0, 0, 0)


def test_untouched_buckets_keep_their_files(spark, table):
    table.write(frame(spark, [("x", f"k{n}", n) for n in range(100)]))
    files = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{table.folder}/rows/bucket=*/*.parquet")}
    before, own = files(), table.stored().where("key = 'k7'").first()["bucket"]
    table.write(frame(spark, [("new", "k7", 7)]), "replace")
    after = files()
    kept = {p for p in before if f"bucket={own}/" not in p}
    assert len(kept) == 7 and all(after[p] == before[p] for p in kept) and not any(p in after for p in before if p not in kept)
    assert len(rows_of(table)) == 100 and table.get("k7").first()["b"] == "new"
    again = rows_of(table)
    table.write(frame(spark, [("new", "k7", 7)]), "replace")
    assert rows_of(table) == again


def test_a_batch_that_was_cut_off_changes_nothing_when_it_is_replayed(spark, tmp_path, monkeypatch):
    table = keyed.Ingested(spark, str(tmp_path / "t"), "key", SCHEMA, 4)
    assert table.append(frame(spark, [("x", f"k{n}", n) for n in range(50)] + [("y", "k3", 0), ("z", None, 1)]), 0) == 50
    second = frame(spark, [("w", f"k{n}", n) for n in range(40, 70)])
    with monkeypatch.context() as m:
        m.setattr(keyed.Ingested, "fence", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.append(second, 1)
    assert not table.fenced("stream-1")
    assert table.append(second, 1) == 20
    whole = rows_of(table)
    assert len(whole) == 70 and len({k for k, *_ in whole}) == 70 and ("k45", 45, "x") in whole and ("k3", 0, "y") in whole
    assert table.append(second, 1) == 0 and table.append(second, 2) == 0 and rows_of(table) == whole


def test_filters_know_every_stored_key_and_few_others(spark, tmp_path):
    table = keyed.Ingested(spark, str(tmp_path / "t"), "key", SCHEMA, 4)
    for number in range(3):
        table.append(spark.range(1000 * number, 1000 * number + 1000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("a"), F.lit("x").alias("b")), number)
    keys = spark.range(0, 6000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumn("bucket", keyed.bucket("key", 4))
    known = {r["key"] for r in table.maybe_known(keys, "none").collect()}
    assert {f"k{n}" for n in range(3000)} <= known and len(known) < 3000 + 300


def test_a_file_stream_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "in")
    table = keyed.Ingested(spark, str(tmp_path / "t"), "key", SCHEMA, 4)
    put = lambda rows: frame(spark, rows).coalesce(1).write.mode("append").parquet(at)
    follow = lambda: table.follow(spark.readStream.schema("b string, key string, a int").parquet(at), str(tmp_path / "checkpoint"))
    put([("x", "k1", 1), ("x", "k2", 2)])
    follow()
    put([("y", "k2", 9), ("y", "k3", 3)])
    with monkeypatch.context() as m:
        m.setattr(keyed.Ingested, "fence", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            follow()
    follow()
    follow()
    assert rows_of(table) == [("k1", 1, "x"), ("k2", 2, "x"), ("k3", 3, "y")]


def test_retention_over_three_batches_and_a_restart(spark, tmp_path):
    at, state = str(tmp_path / "in"), str(tmp_path / "state")
    put = lambda rows: spark.createDataFrame(rows, "session_id long, event_id long, s string").select("session_id", "event_id", F.to_timestamp("s").alias("at")).coalesce(1).write.mode("append").parquet(at)
    schema = "session_id long, event_id long, at timestamp"
    left = lambda: sorted(r["event_id"] for r in streams.retained(spark.readStream.schema(schema).parquet(at), 86400, "1 hour", state).collect())
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    put([(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 12:00:00"), (2, 3, "2024-01-01 12:30:00")])
    assert left() == [1, 2, 3]
    put([(1, 4, "2024-01-02 06:00:00"), (1, 1, "2024-01-01 00:00:00")])  # watermark: Jan 2 05:00, the first entry expires
    assert left() == [2, 3, 4]
    put([(2, 5, "2024-01-01 02:00:00"), (2, 6, "2024-01-03 00:00:00"), (2, 7, "2024-01-01 20:00:00")])  # 5 is too late to enter
    assert left() == [4, 6]
    told = sorted((r["event_id"], r["what"]) for r in spark.read.parquet(f"{state}/out").collect())
    assert (5, "kept") not in told and {(1, "expired"), (2, "expired"), (3, "expired")} <= set(told)
    assert spark.conf.get(name, None) == before


def test_calls_to_the_state_grow_with_keys_not_with_entries():
    calls, value = [], []

    class Handle:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (State() if name.startswith("get") else None)

    class State:
        exists = lambda self: calls.append("exists") or bool(value)
        get = lambda self: calls.append("get") or value[0]
        update = lambda self, x: calls.append("update") or value.__setitem__(slice(None), [x])
        clear = lambda self: calls.append("clear") or value.clear()

    class Times:
        getCurrentWatermarkInMs = lambda self: 1500

    log = type("Kept", (streams.Retention,), {"keep_ms": 1000})()
    log.init(Handle())
    rows = pd.DataFrame({"session_id": [1] * 1000, "event_id": [*range(999), 0], "at_ms": range(1000)})
    out = pd.concat(log.handleInputRows((0, 0), iter([rows]), Times()))
    assert sorted(out["event_id"]) == [0, *range(501, 999)] and set(out["what"]) == {"kept"}
    assert list(log.handleInputRows((0, 0), iter([rows]), Times())) == []
    Times.getCurrentWatermarkInMs = lambda self: 1700
    gone = pd.concat(log.handleExpiredTimer((0, 0), Times(), None))
    assert sorted(gone["event_id"]) == list(range(501, 701)) and set(gone["what"]) == {"expired"}
    assert len(calls) < 20


def test_pages_make_up_the_table(spark, tmp_path):
    rows = [(n // 3 if n % 17 else None, f"v{n}") for n in range(2345)]
    table = spark.createDataFrame(rows, "k long, v string").repartition(7)
    cursor = start = paging.snapshot(table, ["k"], 100, 300, str(tmp_path / "s"))
    spark.createDataFrame([(0, "later")], "k long, v string").count()  # what comes later is in no page
    pages = []
    while cursor:
        page = paging.page(spark, cursor)
        pages.append(page.rows)
        assert page.full_count == 2345 and page.has_more == (len(pages) < 24)
        cursor = page.cursor
    flat = [tuple(r) for p in pages for r in p]
    assert sorted(flat, key=str) == sorted(rows, key=str) and [len(p) for p in pages] == [100] * 23 + [45]
    keys = [-1 if k is None else k for k, _ in flat]
    assert keys == sorted(keys) and paging.page(spark, start).rows == pages[0]


def test_a_late_page_reads_its_ranges_alone(spark, tmp_path):
    cursor = paging.snapshot(spark.range(5000).toDF("k"), ["k"], 100, 500, str(tmp_path / "s"))
    for _ in range(40):
        cursor = paging.following(cursor)
    rows = paging.frame(spark, cursor)
    assert len({r["_range"] for r in rows.select("_range").distinct().collect()}) <= 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan or "_range" in plan.split("PartitionFilters")[1][:80]
    assert sorted(r["k"] for r in rows.collect()) == list(range(4000, 4100))


def test_empty_snapshot(spark, tmp_path):
    page = paging.page(spark, paging.snapshot(spark.range(0).toDF("k"), ["k"], 10, 10, str(tmp_path / "s")))
    assert page.rows == [] and not page.has_more and page.full_count == 0


def test_mentions_in_parts(spark, monkeypatch):
    texts = [(1, "Ann Lee met ann lee and Bob"), (2, None), (3, ""), (4, "bobby LEE"), (5, "nothing")]
    names = [("e1", "ann lee"), ("e2", "Bob"), ("e3", "lee"), ("e4", ""), ("e5", None), ("e6", "BOB")]
    want = {(1, "e1", 2), (1, "e2", 1), (1, "e6", 1), (1, "e3", 2), (4, "e2", 1), (4, "e6", 1), (4, "e3", 1)}
    for limit in (entities.NAMES_BYTES, 30):
        monkeypatch.setattr(entities, "NAMES_BYTES", limit)
        rows = entities.mentions(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(names, "entity string, name string"))
        assert {tuple(r) for r in rows.collect()} == want


def test_a_name_within_itself_counts_without_overlaps(spark):
    texts = [(1, "the the the THE x the the"), (2, "to, to, to"), (3, "a b a b")]
    names = [("e1", "the the"), ("e2", "to, to"), ("e3", "b a"), ("e4", "a b"), ("e5", "the the")]
    rows = entities.mentions(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(names, "entity string, name string"))
    assert {tuple(r) for r in rows.collect()} == {(1, "e1", 3), (1, "e5", 3), (2, "e2", 1), (3, "e3", 1), (3, "e4", 2)}


def test_related_weighs_names_without_overlaps(spark):
    texts = [(1, "to do"), (2, "the the the"), (3, "the the, the the"), (4, "the the")]
    names = spark.createDataFrame([("e1", "the the"), ("e2", "to do")], "entity string, name string")
    edges = entities.mentions(spark.createDataFrame(texts, "id long, text string"), "id", "text", names)
    rows = entities.related(spark.createDataFrame([(9, 4)], "seed long, id long"), edges, fanout=1).collect()
    assert [(r["id"], r["weight"]) for r in rows] == [(3, 2)]
    rows = entities.related(spark.createDataFrame([(9, 3)], "seed long, id long"), edges, fanout=1).collect()
    assert [(r["id"], r["weight"]) for r in rows] == [(2, 1)]


def test_every_observation_with_shared_mentions_is_a_seed(spark):
    t = Tables(spark, DATA)
    seeds = {r["seed"] for r in stores.related_by_entity(t).collect()}
    edges = stores.mention_edges(t).collect()
    shared = Counter(e["entity"] for e in edges)
    assert seeds == {e["id"] for e in edges if shared[e["entity"]] > 1} and any(s % 20 for s in seeds)


def test_hubs_are_capped(spark):
    edges = spark.createDataFrame([(i, "hub", 1 + (i == 77)) for i in range(300)] + [(1, "small", 1), (2, "small", 5)], "id long, entity string, n long")
    rows = entities.related(spark.createDataFrame([(9, 1)], "seed long, id long"), edges, fanout=2, beam=8).collect()
    assert {(r["id"], r["entities"], r["weight"]) for r in rows} == {(77, 1, 2), (0, 1, 1), (2, 1, 5)}


def test_a_stored_table_follows_its_source(spark, tmp_path):
    at = str(tmp_path / "source")
    spark.range(3).write.parquet(at)
    get = lambda: stored(lambda: spark.read.parquet(at), spark, "copy", at).count()
    assert get() == 3
    spark.range(6).write.mode("overwrite").parquet(at)
    assert get() == 6
