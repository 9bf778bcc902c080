"""Queries over writes, sessions, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import indexing, memory
from .registry import query
from .tables import EPOCH, Tables

_OLD = 'old as (select "key", content_hash, status, session_id from observations where doc_id % 3 <> 0)'
_NEW = """new as (select "key", content_hash, case when doc_id % 2 = 0 then 'changed' end status, 'n' || doc_id session_id from observations where doc_id % 3 <> 1)"""


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.observations
    new = rows.where("doc_id % 3 <> 1").select("key", "content_hash", F.when(F.col("doc_id") % 2 == 0, "changed").alias("status"), F.concat(F.lit("n"), "doc_id").alias("session_id"))
    return rows.where("doc_id % 3 <> 0").select("key", "content_hash", "status", "session_id"), new


@query(f'with {_OLD}, {_NEW} select * from old union all select * from new where "key" not in (select "key" from old)', "observations")
def upsert_ignore(t: Tables) -> DataFrame:
    return memory.upserted(*_old_new(t), "key", "ignore")


@query(f'with {_OLD}, {_NEW} select * from new union all select * from old where "key" not in (select "key" from new)', "observations")
def upsert_replace(t: Tables) -> DataFrame:
    return memory.upserted(*_old_new(t), "key", "replace")


@query(
    f'with {_OLD}, {_NEW} select "key", coalesce(n.content_hash, o.content_hash) content_hash, coalesce(n.status, o.status) status, coalesce(n.session_id, o.session_id) session_id from old o full join new n using ("key")',
    "observations",
)
def upsert_update(t: Tables) -> DataFrame:
    return memory.upserted(*_old_new(t), "key", "update")


@query(f'with {_OLD}, {_NEW} select * from old union all select * from new where "key" not in (select "key" from old)', "observations")
def upsert_error_without_clash(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    return memory.upserted(old, new.join(old, "key", "left_anti"), "key", "error")


@query(f'with {_OLD}, {_NEW} select count(*) filter ("key" not in (select "key" from old)) created, count(*) filter ("key" in (select "key" from old)) ignored from new', "observations")
def insert_ignore_counts(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    hit = new.join(old.select("key", F.lit(1).alias("hit")), "key", "left")
    return hit.agg(F.count(F.when(F.col("hit").isNull(), 1)).alias("created"), F.count("hit").alias("ignored"))


@query("select \"key\", case when \"key\" = 'obs_5' then 'archived' else status end status, case when \"key\" = 'obs_5' then 1 else 0 end touched from observations", "observations")
def soft_delete(t: Tables) -> DataFrame:
    rows = memory.archived(t.observations.select("key", "status"), "key", "obs_5", F.timestamp_seconds(F.lit(EPOCH)))
    return rows.select("key", "status", F.col("updated_at").isNotNull().cast("int").alias("touched"))


@query("select content_hash, min(doc_id) doc_id, count(*) copies from observations group by content_hash", "observations")
def dedupe_by_hash(t: Tables) -> DataFrame:
    rows = t.observations.select("content_hash", "doc_id")
    first = memory.first_of(rows, ["content_hash"], F.col("doc_id"))
    return first.join(rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies")), "content_hash")


@query("select session_id, count(*) turns, sum(coalesce(tokens, 0))::bigint tokens, string_agg(role, ',' order by turn_index) roles from messages group by session_id", "messages")
def session_summary(t: Tables) -> DataFrame:
    roles = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("turn_index", "role"))), lambda x: x["role"]))
    return t.messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), roles.alias("roles"))


ROLLING = """select session_id, turn_index from (select *, sum(coalesce(tokens, 0)) over (partition by session_id order by turn_index desc rows unbounded preceding) total
    from (select * from messages qualify row_number() over (partition by session_id order by turn_index desc) <= 6)) where total <= 200"""


@query(ROLLING, "messages")
def rolling_context(t: Tables) -> DataFrame:
    return memory.rolling_context(t.messages, 6, 200).select("session_id", "turn_index")


@query("select session_id, turn_index, role from (select * from messages where session_id = 3 order by turn_index desc limit 5) order by turn_index", "messages")
def recent_turns(t: Tables) -> DataFrame:
    return t.messages.where("session_id = 3").orderBy(F.desc("turn_index")).limit(5).orderBy("turn_index").select("session_id", "turn_index", "role")


@query(
    """select session_id, turn_index, role, coalesce(tokens, 0) tokens from messages
    union all select session_id, -1, 'system', 0 from (select distinct session_id from messages) where session_id not in (select session_id from messages where role = 'system')""",
    "messages",
)
def system_prompt_once(t: Tables) -> DataFrame:
    rows = t.messages.select("session_id", "turn_index", "role", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    without = rows.select("session_id").distinct().join(rows.where("role = 'system'").select("session_id"), "session_id", "left_anti")
    return rows.unionByName(without.select("session_id", F.lit(-1).cast("long").alias("turn_index"), F.lit("system").alias("role"), F.lit(0).cast("long").alias("tokens")))


@query("select session_id, string_agg('[' || upper(role) || '] ' || content, chr(10) order by turn_index) prompt from messages group by session_id", "messages")
def prompt_lines(t: Tables) -> DataFrame:
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.col("content"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn_index", line.alias("line")))), lambda x: x["line"])
    return t.messages.groupBy("session_id").agg(F.concat_ws("\n", lines).alias("prompt"))


@query(
    """with recent as (select * from observations qualify row_number() over (partition by session_id order by created_at_unix desc, "key") <= 100),
    rest as (select session_id, "key", created_at_unix, unnest(tags) tag from recent where id not in (select unnest(consolidates) from reflections where status = 'active')),
    numbered as (select *, row_number() over (partition by session_id, tag order by created_at_unix desc, "key") n, count(*) over (partition by session_id, tag) size from rest)
    select session_id, tag, any_value(size) n, string_agg("key", ',' order by n) members from numbered where size >= 3 and n <= 10 group by session_id, tag""",
    "observations",
    "reflections",
)
def tag_clusters(t: Tables) -> DataFrame:
    return memory.candidates(t.observations, t.reflections).withColumn("members", F.array_join("members", ","))


@query(
    f"""select session_id, string_agg(distinct tag, ',' order by tag) tags, any_value(s) strength, any_value(n) n from (
    select session_id, unnest(tags) tag, round(avg(greatest(0, 1 - ({EPOCH + 3000 * 3600} - created_at_unix) / 86400.0 / 30)) over (partition by session_id), 2) s, count(*) over (partition by session_id) n from observations where status = 'active') group by session_id""",
    "observations",
)
def consolidation_features(t: Tables) -> DataFrame:
    from ..functions.scores import freshness

    age = (F.lit(EPOCH + 3000 * 3600) - F.col("created_at_unix")) / 86400.0
    tags = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("tags")))), ",")
    return t.observations.where("status = 'active'").groupBy("session_id").agg(tags.alias("tags"), F.round(F.avg(freshness(age)), 2).alias("strength"), F.count(F.lit(1)).alias("n"))


@query("select label, max(duration_ms) filter (a = round_even((n - 1) * 0.5, 0)) p50, max(duration_ms) filter (a = round_even((n - 1) * 0.95, 0)) p95, max(duration_ms) filter (a = round_even((n - 1) * 0.99, 0)) p99 from (select label, duration_ms, row_number() over (partition by label order by duration_ms) - 1 a, count(*) over (partition by label) n from spans where duration_ms is not null) group by label", "spans")
def nearest_rank_latency(t: Tables) -> DataFrame:
    return memory.nearest_rank(t.spans, "label", "duration_ms")


@query("select label, round(quantile_cont(duration_ms, 0.85), 6) p85 from spans group by label", "spans")
def interpolated_percentile(t: Tables) -> DataFrame:
    return t.spans.groupBy("label").agg(F.round(F.percentile("duration_ms", 0.85), 6).alias("p85"))


@query("select label, round(avg(duration_ms), 6) mean, round(var_pop(duration_ms), 4) variance, max(duration_ms) most, count(*) filter (success) good from spans group by label", "spans")
def span_statistics(t: Tables) -> DataFrame:
    return t.spans.groupBy("label").agg(F.round(F.avg("duration_ms"), 6).alias("mean"), F.round(F.var_pop("duration_ms"), 4).alias("variance"), F.max("duration_ms").alias("most"), F.count(F.when(F.col("success"), 1)).alias("good"))


@query("select k, count(*) n, count(distinct label) labels from spans group by k", "spans")
def json_access(t: Tables) -> DataFrame:
    return t.spans.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"))


@query("select run, epoch, loss, best, epoch - max(case when loss < coalesce(before, 1e300) then epoch end) over (partition by run order by epoch rows unbounded preceding) patience from (select user_id run, event_id epoch, \"value\" loss, min(\"value\") over (partition by user_id order by event_id rows unbounded preceding) best, min(\"value\") over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) before from events)")
def best_and_patience(t: Tables) -> DataFrame:
    rows = t.read("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("loss"))
    along = W.partitionBy("run").orderBy("epoch")
    before = F.min("loss").over(along.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"best": F.min("loss").over(along.rowsBetween(W.unboundedPreceding, 0)), "_new": F.when(F.col("loss") < F.coalesce(before, F.lit(1e300)), F.col("epoch"))})
    return rows.select("run", "epoch", "loss", "best", (F.col("epoch") - F.max("_new").over(along.rowsBetween(W.unboundedPreceding, 0))).alias("patience"))


@query("select id, row_number() over (order by id) - 1 n from vertices where embedding is not null", "vertices")
def dense_index(t: Tables) -> DataFrame:
    return indexing.dense_index(t.vertices.where("embedding is not null").select("id"), "id")


@query("select a.doc_id negative, b.doc_id positive from (select doc_id, row_number() over (order by doc_id) - 1 n from labels where quality = 0) a join (select doc_id, row_number() over (order by doc_id) - 1 n, count(*) over () size from labels where quality = 1) b on a.n % b.size = b.n")
def round_robin_pairs(t: Tables) -> DataFrame:
    rows = t.read("labels")
    a = indexing.dense_index(rows.where("quality = 0").select(F.col("doc_id").alias("negative")), "negative")
    b = indexing.dense_index(rows.where("quality = 1").select(F.col("doc_id").alias("positive")), "positive", "m")
    size = b.agg(F.count(F.lit(1)).alias("size"))
    return a.crossJoin(F.broadcast(size)).withColumn("m", F.col("n") % F.col("size")).join(b, "m").select("negative", "positive")


@query("select doc_id, case when ('0x' || substr(md5('split' || doc_id), 1, 8))::bigint / 4294967296.0::double < 0.8 then 'train' else 'val' end part from labels")
def seeded_split(t: Tables) -> DataFrame:
    place = F.conv(F.substring(F.md5(F.concat(F.lit("split"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return t.read("labels").select("doc_id", F.when(place < 0.8, "train").otherwise("val").alias("part"))


@query("select doc_id from observations where trim(content) <> ''", "observations")
def non_blank(t: Tables) -> DataFrame:
    return t.observations.where(F.trim("content") != "").select("doc_id")


@query("select \"key\", name, mention_count from entities ", "entities")
def entity_counts(t: Tables) -> DataFrame:
    return t.entities.select("key", "name", "mention_count")


@query(
    """select "key", array_to_string(list_filter([case when length(content) not between 1 and 10000 then 'content' end, case when status not in ('active', 'superseded') then 'status' end, case when embedding is null then 'embedding' end], lambda x: x is not null), ',') faults
    from observations where length(content) not between 1 and 10000 or status not in ('active', 'superseded') or embedding is null""",
    "observations",
)
def validation_quarantine(t: Tables) -> DataFrame:
    faults = F.array_compact(F.array(F.when(~F.length("content").between(1, 10000), "content"), F.when(~F.col("status").isin("active", "superseded"), "status"), F.when(F.col("embedding").isNull(), "embedding")))
    return t.observations.select("key", F.array_join(faults, ",").alias("faults")).where("faults <> ''")


@query("select path, substr(content, 1, 200) head from repo_docs", "repo_docs")
def truncated_text(t: Tables) -> DataFrame:
    return t.repo_docs.select("path", F.substring("content", 1, 200).alias("head"))


@query("select coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') directory, count(*) files from repo_docs group by 1", "repo_docs")
def dir_counts(t: Tables) -> DataFrame:
    return t.repo_docs.groupBy(texts.directory(F.col("path")).alias("directory")).agg(F.count(F.lit(1)).alias("files"))


