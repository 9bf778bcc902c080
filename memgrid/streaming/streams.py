"""Streams of changes, turns and events. Each has a batch form that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.stage import shared_folder

#: Parts that the entries of an hour are kept in.
PARTS = 8


def latest(changes: DataFrame) -> DataFrame:
    """(key, op, payload, seq_no) of each key's last change; deletes are tombstones and leave."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("op", "payload"), "seq_no").alias("x"), F.max("seq_no").alias("seq_no"))
    return last.select("key", "x.op", "x.payload", "seq_no").where(~F.col("op").startswith("delete"))


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/memgrid-stream-{name}-{uuid.uuid4().hex}"


def run(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Puts what a stream has now into the folder `at`, each micro-batch in a part of its own, and gives all parts with the column batch.

    A part is overwritten if its batch is run again, and the folder keeps the stream's place: a restart with the same folder goes on there.
    """
    spark = stream.sparkSession
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    sink_dir = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    if not sink_dir.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(sink_dir):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{at}/out").parquet(f"{at}/out")


def drained(stream: DataFrame, name: str, mode: str = "append", key: str | None = None, at: str | None = None) -> DataFrame:
    """All that a stream of what is there now puts out. complete: the last result; update: of each key the rows of its last batch."""
    rows = run(stream, at or folder(stream.sparkSession, name), mode)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch").drop("batch")
    if mode == "update":
        last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
        return rows.join(last, [key, "batch"], "left_semi").drop("batch")
    return rows.drop("batch")


def applied(stream: DataFrame, name: str = "changes", at: str | None = None) -> DataFrame:
    """The table after a change stream (key, seq_no, op, payload). Each batch leaves its last change of each key; the table is the last
    of these by seq_no, so replays change nothing, and a restart with the same folder goes on."""
    spark = stream.sparkSession
    at = at or folder(spark, name)

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("key").agg(F.max_by(F.struct("op", "payload"), "seq_no").alias("x"), F.max("seq_no").alias("seq_no"))
        rows.select("key", "seq_no", "x.op", "x.payload").write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    schema = StructType([stream.schema[c] for c in ("key", "seq_no", "op", "payload")])
    if not out.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(out):
        return spark.createDataFrame([], schema).select("key", "op", "payload", "seq_no")
    return latest(spark.read.schema(schema).parquet(f"{at}/out"))


class Turns(StatefulProcessor):
    """The latest turns of a session within a token budget; a session of which none fits puts out a null turn."""

    turns, budget = 6, 200

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "turn_index long, tokens long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        have = [(x[0], x[1]) for x in self.kept.get()]
        for t in rows:
            have += [(int(a), int(b)) for a, b in zip(t["turn_index"], t["tokens"].fillna(0), strict=True)]
        have = sorted(have)[-self.turns :]
        while have and sum(b for _, b in have) > self.budget:
            have.pop(0)
        self.kept.clear()
        if have:
            self.kept.put([(a, b) for a, b in have])
        turn = pd.array([a for a, _ in have] or [None], dtype="Int64")
        yield pd.DataFrame({"session_id": pd.Series([key[0]] * len(turn), dtype="int64"), "turn_index": turn})

    def close(self) -> None:
        pass


class Retention(StatefulProcessor):
    """Log entries of a key that haven't expired. Each puts out a row when it comes, and one when it goes: (session_id, event_id, what).

    A key's entries are one value, three columns of eight-byte integers, with one timer for the entry that goes first; so the calls to the
    state grow with the keys, not with the entries.
    """

    keep_ms = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", "sessions binary, events binary, ends binary, timer long")

    def held(self) -> tuple[pd.DataFrame, int | None]:
        """The entries (session_id, event_id, end), and when the timer goes off."""
        found = self.log.get() if self.log.exists() else (b"", b"", b"", None)
        return pd.DataFrame({name: np.frombuffer(bytes(x), np.int64) for name, x in zip(("session_id", "event_id", "end"), found, strict=False)}), found[3]

    def keep(self, rows: pd.DataFrame, timer: int | None) -> None:
        """Holds these entries, of which the first to go sets the timer."""
        if not len(rows):
            self.log.clear()
            return
        first = int(rows["end"].min()) - 1  # a timer goes off once the watermark is past it
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.log.update((*(rows[name].to_numpy(np.int64).tobytes() for name in ("session_id", "event_id", "end")), first))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        new = pd.concat([t[["session_id", "event_id", "at_ms"]] for t in rows])
        new = new.assign(end=new["at_ms"].astype("int64") + self.keep_ms).drop(columns="at_ms")
        new = new[new["end"] > now]
        held, timer = self.held()
        both = pd.concat([held, new.astype("int64")], ignore_index=True)
        fresh = ~both.duplicated(["session_id", "event_id"]).to_numpy()
        told = both[fresh & (np.arange(len(both)) >= len(held))]
        if len(told):
            self.keep(both[fresh], timer)
            yield self.told(told, "kept")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held, _ = self.held()
        gone = held["end"] <= timerValues.getCurrentWatermarkInMs()
        self.keep(held[~gone], None)
        if gone.any():
            yield self.told(held[gone], "expired")

    def told(self, rows: pd.DataFrame, what: str) -> pd.DataFrame:
        return rows[["session_id", "event_id"]].assign(what=what)

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """State that transformWithState needs is kept in RocksDB while this lasts; then the session's setting is as before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def retention(log: DataFrame, keep: int, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """(session_id, event_id, what): the comings and goings of a log stream (session_id, event_id, at).

    An entry expires `keep` seconds after its time, by the watermark, and leaves the state then; one that comes later than that never
    enters. State is kept for each hour and one of PARTS parts of its entries by a hash; repeated entries count once.
    """
    kind = type("Kept", (Retention,), {"keep_ms": keep * 1000})
    rows = log.withWatermark("at", late).withColumns({"at_ms": F.unix_millis("at"), "period": F.window("at", every)["start"], "part": F.pmod(F.xxhash64("session_id", "event_id"), F.lit(PARTS))})
    return rows.groupBy("period", "part").transformWithStateInPandas(kind(), "session_id long, event_id long, what string", "Update", "EventTime")


def retained(log: DataFrame, keep: int, late: str = "1 hour", at: str | None = None) -> DataFrame:
    """(session_id, event_id) of what is left of a log stream after all that is there now; a restart with the same folder goes on."""
    with state_store(log.sparkSession):
        rows = run(retention(log, keep, late), at or folder(log.sparkSession, "retention"))
    last = rows.groupBy("session_id", "event_id").agg(F.max(F.when(F.col("what") == "expired", 1).otherwise(0)).alias("gone"))
    return last.where("gone = 0").select("session_id", "event_id")


def rolling(messages: DataFrame) -> DataFrame:
    """(session_id, turn_index) of what stays of each session, over a stream (session_id, turn_index, tokens); a batch puts out all of the
    sessions that it changes."""
    return messages.groupBy("session_id").transformWithStateInPandas(Turns(), "session_id long, turn_index long", "Update", "None")


def rolled(messages: DataFrame, at: str | None = None) -> DataFrame:
    """What rolling() leaves after all batches."""
    with state_store(messages.sparkSession):
        return drained(rolling(messages), "turns", "update", "session_id", at).where("turn_index is not null")


def activity(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): bursts of a user's events (user_id, at), in batch or as a stream with a watermark."""
    rows = events.withWatermark("at", late) if events.isStreaming else events
    grouped = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rates(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, label, n, total) of each window of events (at, label, value)."""
    rows = events.withWatermark("at", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("at", every).alias("w"), "label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "label", "n", "total")


def first_seen(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
