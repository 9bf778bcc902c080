"""Queries over readers, symbols, records and further combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import chunks, memory
from ..operators.indexing import dense_index
from ..sources import symbols
from ..sources.stage import spread
from .registry import query
from .tables import EPOCH, Tables
from .writes import ROLLING

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" union all ".join(f"select '{t}' table_name, count(*) n from {t}" for t in TABLES))
def scan_counts(t: Tables) -> DataFrame:
    out = None
    for name in TABLES:
        rows = t.read(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select page_id, len(list_distinct(list_filter(regexp_extract_all(content, '[A-Za-z_]\\w{2,}'), lambda x: length(x) > 2))[1:100]) identifiers from repo_docs", "repo_docs")
def generic_identifiers(t: Tables) -> DataFrame:
    names = F.slice(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w{2,}"), F.lit(0))), 1, 100)
    return t.repo_docs.select("page_id", F.size(names).cast("long").alias("identifiers"))


@query("select doc_id, count(*) chunks, max(end_token) total from doc_chunks group by doc_id having count(*) > 1", "doc_chunks")
def chunk_totals(t: Tables) -> DataFrame:
    rows = chunks.windows(t.read("documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("end_token").alias("total")).where("chunks > 1")


@query(
    """select doc_id, unnest(list_filter(['How is ' || lang || ' used?', case when source <> 'src0' then 'What does ' || source || ' hold?' end], lambda x: x is not null)) question from documents"""
)
def query_templates(t: Tables) -> DataFrame:
    made = F.array_compact(F.array(F.format_string("How is %s used?", "lang"), F.when(F.col("source") != "src0", F.format_string("What does %s hold?", "source"))))
    return t.read("documents").select("doc_id", F.explode(made).alias("question"))


@query(
    """with d as (select doc_id, source, row_number() over (order by doc_id) - 1 n, count(*) over () size from documents),
    c as (select a.doc_id, b.doc_id other, k from d a, (select unnest([0, 1, 2, 3]) k) k join d b on b.n = ('0x' || substr(md5(a.doc_id || '-' || k.k), 1, 12))::bigint % a.size where b.source <> a.source)
    select doc_id, other negative from c qualify row_number() over (partition by doc_id order by k) <= 2"""
)
def sampled_negatives(t: Tables) -> DataFrame:
    """Up to two documents of another source for each document, at places drawn by a hash in four tries."""
    d = dense_index(t.read("documents").select("doc_id", "source"), "doc_id")
    size = d.agg(F.count(F.lit(1)).alias("size"))
    tries = d.select("doc_id", "source", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).crossJoin(F.broadcast(size))
    at = F.conv(F.substring(F.md5(F.concat_ws("-", "doc_id", "k")), 1, 12), 16, 10).cast("long") % F.col("size")
    other = d.select("n", F.col("doc_id").alias("negative"), F.col("source").alias("s"))
    rows = tries.withColumn("n", at).join(other, "n").where("s <> source")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("k"))).where("place <= 2").select("doc_id", "negative")


@query(
    f"""select label, count(*) n from (select 'today' label from observations where created_at_unix >= {EPOCH + 86400 * 8} union all select 'last 3 days' from observations where created_at_unix >= {EPOCH + 86400 * 8 + 43200 - 3 * 86400} union all select 'none' from observations) group by label""",
    "observations",
)
def time_words(t: Tables) -> DataFrame:
    """Rows since a time word, seen from a fixed moment; unknown words set no limit."""
    from ..functions.times import since

    at = EPOCH + 86400 * 8 + 43200
    out = None
    for word, name in (("today", "today"), ("last 3 days", "last 3 days"), ("whenever", "none")):
        rows = t.observations.where(memory.conditions(since(word, at))).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select user_id, arg_max(event_type, event_id) last_label, max(ts)::varchar last_at from events group by user_id")
def latest_by_key(t: Tables) -> DataFrame:
    return t.read("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_label"), F.max("ts").cast("string").alias("last_at"))


@query("select l_orderkey, l_linenumber, to_json({'outbound': {'w': w_out}, 'line': l_linenumber})::varchar record from pair_inputs", "pair_inputs")
def nested_records(t: Tables) -> DataFrame:
    record = F.to_json(F.struct(F.struct(F.col("w_out").alias("w")).alias("outbound"), F.col("l_linenumber").alias("line")))
    return t.pair_inputs.select("l_orderkey", "l_linenumber", record.alias("record"))


@query("select session_id, role, count(*) n from messages group by session_id, role", "messages")
def session_counters(t: Tables) -> DataFrame:
    """Counters of a session as a map, taken apart again."""
    counts = t.messages.groupBy("session_id", "role").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("stats"))
    return maps.select("session_id", F.explode("stats").alias("role", "n"))


@query("select path, size from (select path, length(content) size from repo_docs) order by size desc, path limit 1", "repo_docs")
def largest_file(t: Tables) -> DataFrame:
    rows = t.repo_docs.select("path", F.length("content").cast("long").alias("size"))
    return rows.orderBy(F.desc("size"), "path").limit(1)


@query("select w term, count(distinct doc_id) docs from (select doc_id, unnest(list_distinct(regexp_split_to_array(lower(\"text\"), '[^\\p{L}\\p{N}_]+'))) w from documents) where length(w) > 2 group by w")
def inverted_index(t: Tables) -> DataFrame:
    """How many documents each lower-case term has."""
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2))
    docs = spread(t.read("documents").select("doc_id", "text"))
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    once = docs.join(twice, "doc_id", "left_anti").select(F.explode(terms).alias("term"))
    again = docs.join(twice, "doc_id", "left_semi").select("doc_id", F.explode(terms).alias("term")).distinct().select("term")
    return once.unionByName(again).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


@query(ROLLING, "messages")
def rolling_context_stream(t: Tables) -> DataFrame:
    from ..streaming import streams
    rows = t.stream("conversations")
    tokens = F.when(F.col("turn") % 9 != 8, F.floor(F.length("text") / 4).cast("long"))
    return streams.rolled(rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), tokens.alias("tokens")))


@query("select path, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') directory, regexp_extract(path, '[^/]*$') file_name from repo_docs", "repo_docs")
def path_parts(t: Tables) -> DataFrame:
    return t.repo_docs.select("path", texts.directory(F.col("path")).alias("directory"), texts.file_name(F.col("path")).alias("file_name"))


@query()
def surprise_chunks(t: Tables) -> DataFrame:
    """Documents cut where unigram surprise peaks, with the mean surprise around each cut; the chunks of a text make up the whole text."""
    from ..operators import surprise

    return surprise.cut_chunks(spread(t.read("documents").select("doc_id", "text")), "doc_id", "text")


@query(f'with old as (select "key", status from observations where doc_id % 3 <> 0), new as (select "key", status from observations) select * from new where "key" not in (select "key" from old)', "observations")
def append_new(t: Tables) -> DataFrame:
    from ..sources import sinks

    rows = t.observations.select("key", "status", "doc_id")
    return sinks.appended(rows.where("doc_id % 3 <> 0").select("key", "status"), rows.unionByName(rows), "key")
