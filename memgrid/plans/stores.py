"""Stored tables: merges, ingestion by streams, cursors, mentions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import entities, paging
from ..sources.keyed import Ingested, Keyed
from ..sources.stage import shared_folder, stored
from ..streaming import streams
from .registry import query
from .tables import EPOCH, Tables


@query(
    """with n as (select doc_id, 'obs_' || doc_id as "key", source status, case when doc_id % 4 = 0 then null else lang end note from documents where doc_id % 3 <> 1),
    o as (select 'obs_' || doc_id as "key", lang status, source note from documents where doc_id % 2 = 0)
    select "key", coalesce(n.status, o.status) status, coalesce(n.note, o.note) note from o full join n using ("key")"""
)
def stored_merge(t: Tables) -> DataFrame:
    """Two writes into a stored table: the second fills in or adds rows, bucket by bucket."""
    rows = t.read("documents")
    key = F.concat(F.lit("obs_"), "doc_id").alias("key")
    table = Keyed(t.spark, f"{shared_folder(t.spark)}/memgrid-merge-{uuid.uuid4().hex}", "key", StructType().add("key", "string").add("status", "string").add("note", "string"), 16)
    table.write(rows.where("doc_id % 2 = 0").select(key, F.col("lang").alias("status"), F.col("source").alias("note")), "error")
    table.write(rows.where("doc_id % 3 <> 1").select(key, F.col("source").alias("status"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("note")), "update")
    return table.rows()


@query("""select 'sha256:' || sha256("text") as "key", min(doc_id) doc_id from documents where "text" is not null group by 1""")
def file_stream_ingestion(t: Tables) -> DataFrame:
    """A file stream into a table with one row for each content, twice: the second stream brings nothing new."""
    at = f"{shared_folder(t.spark)}/memgrid-ingest-{uuid.uuid4().hex}"
    table = Ingested(t.spark, f"{at}/table", "key", StructType().add("doc_id", "long").add("key", "string"), 16)
    for name in ("first", "second"):
        rows = t.stream("documents").where("text is not null").select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("key"))
        table.follow(rows, f"{at}/checkpoint-{name}", name)
    return table.rows().select("key", "doc_id")


@query("""select event_id, (row_number() over (order by ts, event_id) - 1) // 1000 page from events qualify page < 5""")
def cursor_pages(t: Tables) -> DataFrame:
    """The first five pages of the events by time, by cursors over a snapshot; each page reads the ranges that hold it."""
    cursor, out = paging.snapshot(t.read("events").select("ts", "event_id"), ["ts", "event_id"], 1000, 2500), None
    for number in range(5):
        rows = paging.frame(t.spark, cursor).select("event_id", F.lit(number).cast("long").alias("page"))
        out = rows if out is None else out.unionByName(rows)
        cursor = paging.following(cursor)
        if cursor is None:
            break
    return out


def _mentions(t: Tables) -> DataFrame:
    """(id, entity, n): observations that have the name of an entity, once a session."""
    names = t.named_entities
    make = lambda: entities.mentions(t.read("documents").select(F.col("doc_id").alias("id"), "text"), "id", "text", names)
    return stored(make, t.spark, "mentions", f"{t.sf_dir}/documents.parquet")


@query("select id, entity, n from mentions", "mentions")
def mention_edges(t: Tables) -> DataFrame:
    """Mention edges: which texts have the name of each entity, and how often."""
    return _mentions(t)


@query(
    """with heads as (select * from mentions qualify row_number() over (partition by entity order by n desc, id) <= 4),
    p as (select s.id seed, h.id, h.entity, h.n from mentions s join heads h using (entity) where h.id <> s.id qualify row_number() over (partition by s.id, h.entity order by h.n desc, h.id) <= 3)
    select seed, id, count(distinct entity) entities, sum(n)::bigint weight from p group by seed, id qualify row_number() over (partition by seed order by count(distinct entity) desc, sum(n) desc, id) <= 8""",
    "mentions",
)
def related_by_entity(t: Tables) -> DataFrame:
    """From every observation over the entities that it mentions to others: three of an entity, eight of an observation."""
    edges = _mentions(t)
    return entities.related(edges.select(F.col("id").alias("seed"), "id").distinct(), edges)


@query(
    """with f as (select * from mentions qualify row_number() over (partition by id order by n desc, entity) <= 50),
    c as (select a.entity, b.entity other, count(*) together from f a join f b using (id) where a.entity <> b.entity group by all)
    select * from c qualify row_number() over (partition by entity order by together desc, other) <= 3""",
    "mentions",
)
def around_entity(t: Tables) -> DataFrame:
    """For each entity the three that are mentioned with it most."""
    edges = _mentions(t)
    return entities.around(edges.select("entity").distinct(), edges)


@query(
    f"""with o as (select doc_id id, session_id from observations where created_at_unix >= {EPOCH} + 3600 * 100)
    select session_id, count(distinct id) observations, list_sort(coalesce(list(distinct entity) filter (entity is not null), [])) entities from o left join mentions using (id) group by session_id""",
    "observations",
    "mentions",
)
def session_entities(t: Tables) -> DataFrame:
    """What each session since a time was about: its observations and the entities that they mention."""
    rows = t.observations.select(F.col("doc_id").alias("id"), "session_id", "created_at_unix")
    return entities.by_session(rows, _mentions(t), EPOCH + 3600 * 100)


_KEPT = 10 * 86400


@query(f"""select user_id session_id, event_id from events where epoch_us(ts) // 1000 + {_KEPT} * 1000 > (select max(epoch_us(ts)) // 1000 from events) - 3600000""")
def retained_log(t: Tables) -> DataFrame:
    """The recall log as a stream, of which entries expire ten days after their time by the watermark."""
    rows = t.stream("events").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("at"))
    return streams.retained(rows, _KEPT, "1 hour").select("session_id", "event_id")
