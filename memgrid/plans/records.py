"""Queries over session records, settings, code and configuration files, embeddings and filtered retrieval."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import embed, scores, texts
from ..operators import dependencies, graph, learning, memory, recall, sessions
from ..operators.indexing import dense_index
from ..sources import files, sinks, symbols
from ..sources.stage import shared_folder, spread
from .registry import query
from .retrieval import _EDGES, _MEMORY, _SEEDS, AS_OF, SIM, _memory_hop, asked
from .tables import EPOCH, Tables

# Retrieval with filters.

_SINCE = EPOCH + 3600 * 40
_TAGS = ["en", "de", "src3"]
_ALL = """allv as (select v.*, o.tags, o.memory_type from vertices v left join observations o using (id))"""
_FILTERED = (
    "with "
    + _ALL
    + ", "
    + _SEEDS.format("pattern, ", f"select * from ({_EDGES}) where dst in (select id from vertices where created_at_unix >= {_SINCE})").replace(
        f"seeds as (select id, {SIM.format('embedding')} score from observations where embedding is not null order by score desc, id limit 6)",
        f"""seeds as (select id, score from (select id, collection, {SIM.format('embedding')} score from allv where embedding is not null and created_at_unix >= {_SINCE}
        and list_has_any(tags, {_TAGS}) and memory_type in ('decision', 'event', 'learning')) where score >= 0.1 qualify row_number() over (partition by collection order by score desc, id) <= 6)""",
    )
    + _memory_hop(0)
    + _memory_hop(1)
    + """, u as (select id, score, rank, pos from (select unnest(path) id, generate_subscripts(path, 1) pos, score, rank from b2) qualify row_number() over (partition by id order by rank, pos) = 1)
    select u.id, v.collection, u.score, row_number() over (order by u.score desc, u.rank, u.pos) place from u join vertices v using (id) order by u.score desc, u.rank, u.pos limit 5"""
)


def _described(t: Tables) -> DataFrame:
    """Vertices of all collections with what filters look at."""
    own = t.observations.select("id", "tags", "memory_type", "status")
    return t.vertices.join(own, "id", "left")


@query(_FILTERED, "relationships", "vertices")
def retrieve_memories_filtered(t: Tables) -> DataFrame:
    """Time, tag and type filters, a floor of similarity, and several collections."""
    queries = asked(t).select(F.lit(1).alias("query_id"), "q")
    edges = graph.memory_edges(t.relationships, t.reflections)
    rows = recall.retrieved(_described(t), edges, queries, 5, 0.1, since=_SINCE, tags=_TAGS, kinds=["decision", "event", "learning"], as_of=float(AS_OF))
    return rows.select("id", "collection", "score", F.col("place").cast("long").alias("place"))


def _seeds(t: Tables) -> DataFrame:
    rows = recall.seeds(t.vertices.where("collection = 'observations'"), asked(t).select(F.lit(1).alias("query_id"), "q"), -1.0)
    return rows.select("query_id", "id", "score")


@query(_MEMORY + " select sum(len(path))::bigint nodes, sum(len(path) - 1)::bigint edges from b2", "relationships", "vertices")
def path_counters(t: Tables) -> DataFrame:
    edges = graph.memory_edges(t.relationships, t.reflections)
    return graph.counters(graph.memory_beam(_seeds(t), edges, t.vertices, asked(t).select(F.lit(1).alias("query_id"), "q"), as_of=float(AS_OF)))


@query(
    _MEMORY
    + """ select 0 hop, (select count(*) from b0) + count(*) nodes_visited, count(*) edges_traversed from b0 b join near e on e.src = b.tail
    union all select 1, count(*), count(*) from b1 b join near e on e.src = b.tail""",
    "relationships",
    "vertices",
)
def traversal_counters(t: Tables) -> DataFrame:
    edges, queries = graph.memory_edges(t.relationships, t.reflections), asked(t).select(F.lit(1).alias("query_id"), "q")
    first = graph.start(_seeds(t), 8)
    second = graph.memory_beam(_seeds(t), edges, t.vertices, queries, hops=1, as_of=float(AS_OF))
    return graph.visits([first, second], graph.capped(edges, 3, F.col("pattern")))


@query("select from_id src, to_id dst from relationships qualify row_number() over (partition by from_id order by strength desc, to_id) <= 1", "relationships")
def halved_fanout(t: Tables) -> DataFrame:
    edges = t.relationships.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("strength").alias("weight"))
    return graph.halved(edges, 3).select("src", "dst")


@query("select kind, count(*) n, array_to_string(list(round(coalesce(strength, 1.0), 3)::decimal(9, 3) order by strength)[1:5], ',') least from relationships group by kind", "relationships")
def edge_weight_lists(t: Tables) -> DataFrame:
    rows = t.relationships.select("kind", F.coalesce("strength", F.lit(1.0)).alias("w"))
    least = rows.withColumn("n", F.row_number().over(W.partitionBy("kind").orderBy("w"))).where("n <= 5")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("w")), lambda x: F.round(x, 3).cast("decimal(9,3)").cast("string")), ",")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(least.groupBy("kind").agg(text.alias("least")), "kind")


@query()
def cell_neighbours(t: Tables) -> DataFrame:
    """Three neighbours of every vector whose id is divisible by 20, by an inverted file of cells over all vectors."""
    from ..operators.knn import near_cells

    return near_cells(t.embeddings, "vec_id", "embedding", 3, F.col("vec_id") % 20 == 0)


# Records of sessions.


@query(
    """select user_id session_id, count(*) recalls, sum((props::json->>'k')::bigint)::bigint results, round(sum("value"), 4) duration_ms, count(*) filter (where event_id % 5 <> 0) noted from events group by user_id"""
)
def recall_log(t: Tables) -> DataFrame:
    """The log after two appends, read back by session."""
    note = F.when(F.col("event_id") % 5 == 0, "").otherwise("seen")
    rows = t.read("events").select("event_id", F.col("user_id").alias("session_id"), F.concat_ws(" ", "event_type", "event_id").alias("query"), F.get_json_object("props", "$.k").alias("result_count"), F.col("value").alias("duration_ms"), F.col("ts").cast("timestamp").alias("created_at"), note.alias("notes"))
    at = f"{shared_folder(t.spark)}/memgrid-recall-{uuid.uuid4().hex}"
    for part in (0, 1):
        sessions.append_recall(rows.where(F.col("event_id") % 2 == part), at)
    log = t.spark.read.schema(sessions.recall_rows(rows).schema).parquet(at)
    sums = (F.count_distinct("key").alias("recalls"), F.sum("result_count").alias("results"), F.round(F.sum("duration_ms"), 4).alias("duration_ms"), F.count("notes").alias("noted"))
    return log.groupBy("session_id").agg(*sums)


@query(
    """select conv_id, turn, 'max_tokens=' || case when turn % 3 = 0 then '64' else '256' end || case when turn % 4 = 1 then ';stop=user' when turn % 2 = 0 then ';stop=END|STOP' else '' end || ';temperature=' || case when role = 'user' then '0.7' else '0.2' end settings from conversations"""
)
def prompt_envelopes(t: Tables) -> DataFrame:
    entry = lambda k, v: F.create_map(F.lit(k), v)
    none = F.create_map().cast("map<string,string>")
    base = F.map_from_arrays(F.array(F.lit("temperature"), F.lit("max_tokens")), F.array(F.lit("0.2"), F.lit("256")))
    own = F.when(F.col("turn") % 4 == 1, entry("stop", F.lit("user"))).otherwise(none)
    warm = F.when(F.col("role") == "user", entry("temperature", F.lit("0.7"))).otherwise(none)
    short = F.when(F.col("turn") % 3 == 0, entry("max_tokens", F.lit("64"))).otherwise(none)
    stop = F.when(F.col("turn") % 2 == 0, "END|STOP").otherwise("")
    made = sessions.envelope(sessions.merged(base, own), sessions.merged(warm, short), stop)
    line = F.array_join(F.transform(F.array_sort(F.map_entries(made)), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    return t.read("conversations").select("conv_id", "turn", line.alias("settings"))


@query(
    """select n_nationkey, block, name, value from (select n_nationkey, unnest([{'block': 'model', 'name': 'size', 'value': case when n_nationkey % 2 = 0 then 'large' else 'small' end}, {'block': 'model', 'name': 'region', 'value': n_regionkey::varchar},
    {'block': 'limits', 'name': 'top', 'value': '5'}, {'block': 'log', 'name': 'name', 'value': n_name}], recursive := true) from nation)"""
)
def deep_merges(t: Tables) -> DataFrame:
    """Settings of two levels, a base with overrides, taken apart again."""
    one = lambda k, v: F.create_map(F.lit(k), v)
    base = F.map_from_arrays(F.array(F.lit("model"), F.lit("limits")), F.array(F.map_concat(one("size", F.lit("small")), one("region", F.lit("none"))), one("top", F.lit("5"))))
    size = F.when(F.col("n_nationkey") % 2 == 0, one("size", F.lit("large"))).otherwise(F.create_map().cast("map<string,string>"))
    over = F.map_from_arrays(F.array(F.lit("model"), F.lit("log")), F.array(F.map_concat(size, one("region", F.col("n_regionkey").cast("string"))), one("name", F.col("n_name"))))
    rows = t.read("nation").select("n_nationkey", F.explode(sessions.deep_merged(base, over)).alias("block", "own"))
    return rows.select("n_nationkey", "block", F.explode("own").alias("name", "value"))


@query(
    """with l as (select *, case when w_out > 0 and r_encode > 0 and h_out > 0 then w_out * r_encode * h_out / t_out else 0 end a, case when w_in > 0 and r_decode > 0 and h_in > 0 then w_in * r_decode * h_in / t_in else 0 end b from pair_inputs),
    m as (select *, case when a > 0 and b > 0 then 2.0 * a * b / (a + b) else 0 end mean from l)
    select l_orderkey, l_linenumber, 'line_' || l_linenumber label, round(context, 6) context, round(case when mean > 0 then mean * pow(context, alpha) * 0.9 else 0 end, 6) pair, case when mean <= 0 then 'bottleneck' end gate from m""",
    "pair_inputs",
)
def boundary_records(t: Tables) -> DataFrame:
    """The score of a boundary with its context from four components."""
    c = F.col
    rows = t.pair_inputs
    parts = {"L": c("w_out") / 10, "I": c("w_in") / 10, "A": c("h_out"), "G": F.lit(0.5)}
    legs = scores.bottleneck(c("w_out"), c("r_encode"), c("h_out"), c("t_out")), scores.bottleneck(c("w_in"), c("r_decode"), c("h_in"), c("t_in"))
    made = sessions.boundary(F.concat(F.lit("line_"), "l_linenumber"), *legs, parts, F.lit(0.9), c("alpha"))
    return rows.select("l_orderkey", "l_linenumber", *made).select("l_orderkey", "l_linenumber", "label", F.round("context", 6).alias("context"), F.round("score.pair", 6).alias("pair"), "score.gate")


@query(
    """with recent as (select * from observations qualify row_number() over (partition by session_id order by created_at_unix desc, "key") <= 100),
    rest as (select session_id, "key", id, created_at_unix, substr(coalesce(content, ''), 1, 80) head, unnest(tags) tag from recent where id not in (select unnest(consolidates) from reflections where status = 'active')),
    numbered as (select *, row_number() over (partition by session_id, tag order by created_at_unix desc, "key") n, count(*) over (partition by session_id, tag) size from rest),
    g as (select session_id, tag, string_agg(id, ',' order by n) ids, count(*) source_count, string_agg(head, chr(10) order by n) content from numbered where size >= 3 and n <= 10 and tag is not null group by session_id, tag)
    select 'ref_' || substr(sha256(session_id || '|' || tag || '|' || ids), 1, 16) "key", session_id, tag, ids consolidates, source_count, content from g""",
    "observations",
    "reflections",
)
def consolidated_sessions(t: Tables) -> DataFrame:
    """The reflections that consolidating all sessions would write."""
    found = memory.candidates(t.observations, t.reflections).where("tag is not null")
    return memory.consolidated(found, t.observations).withColumn("consolidates", F.array_join("consolidates", ","))


@query("select event_id, 'obs_' || strftime(ts, '%Y-%m-%dT%H-%M-%S.%f') || 'Z_' || substr(md5(event_id::varchar), 1, 8) \"key\" from events")
def timestamp_keys(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", sessions.timestamp_key("obs", F.col("ts").cast("timestamp"), F.col("event_id").cast("string")).alias("key"))


@query("select event_id, case when event_id % 7 <> 0 then epoch_us(date_trunc('second', ts)) // 1000000 end \"at\" from events")
def iso_times(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, "yesterday").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.read("events").select("event_id", F.unix_timestamp(sessions.parsed_time(text)).alias("at"))


@query(
    """select conv_id, '<memory_metadata>' || chr(10) || '- Memory last updated: ' || strftime(make_timestamp((1704067200 + conv_id * 3600) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10) || '- ' || count(*) || ' previous messages stored in recall memory'
    || case when conv_id % 3 > 0 then chr(10) || '- ' || conv_id % 3 || ' total items in archival memory' else '' end || chr(10) || '- Available archival memory tags: ' || array_to_string(list_sort(list_distinct(list(role))), ', ') || chr(10) || '</memory_metadata>' block from conversations group by conv_id"""
)
def metadata_blocks(t: Tables) -> DataFrame:
    rows = t.read("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("role").alias("roles"))
    edited = F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 3600)
    return rows.select("conv_id", sessions.metadata_block(edited, F.col("n"), F.col("conv_id") % 3, F.col("roles")).alias("block"))


@query(
    """select event_id, case event_id % 6 when 0 then 'true' when 1 then 'true' when 2 then 'false' when 3 then 'float' when 4 then case when (props::json->>'k')::bigint in (0, 1) then case (props::json->>'k')::bigint when 0 then 'false' else 'true' end else 'int' end else 'text' end kind,
    case when event_id % 6 = 3 then "value" when event_id % 6 = 4 and (props::json->>'k')::bigint > 1 then (props::json->>'k')::double end number from events"""
)
def settings_coerced(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    n = F.col("event_id") % 6
    text = F.when(n == 0, "TRUE").when(n == 1, "1").when(n == 2, "Off").when(n == 3, F.col("value").cast("string")).when(n == 4, k).otherwise(F.col("event_type"))
    return t.read("events").select("event_id", sessions.coerced(text).alias("x")).select("event_id", "x.kind", "x.number")


@query(
    """with recursive o as (select event_id, case when event_type <> 'error' then 'done' when (props::json->>'k')::bigint % 8 < 6 then 'retry' else 'dead' end own from events),
    n as (select event_id, unnest(case when event_id % 3 = 2 or event_id % 30 = 0 or event_id % 3000 = 1 then [] when event_id % 90 = 3 then [event_id + 6] when event_id % 3 = 0 then [event_id - 3, event_id - 7] else [event_id - 3] end) need from o where own = 'done'),
    r as (select event_id, need from n union select r.event_id, n.need from r join n on n.event_id = r.need),
    c as (select event_id from r where event_id = need),
    w as (select r.event_id, max(case when o.own = 'dead' then 2 when o.own is null or o.own = 'retry' or r.need in (from c) then 1 else 0 end) worst from r left join o on o.event_id = r.need group by r.event_id)
    select event_id, case when own <> 'done' then own when worst = 2 then 'blocked' when event_id in (from c) then 'circle' when worst = 1 then 'waiting' else 'done' end state from o left join w using (event_id)"""
)
def change_dependencies(t: Tables) -> DataFrame:
    """Which changes are done, wait, are to be tried again, wait for themselves, or are blocked by one that is dead; chains of a thousand."""
    n = F.col("event_id")
    none = F.array().cast("array<bigint>")
    needs = F.when((n % 3 == 2) | (n % 30 == 0) | (n % 3000 == 1), none).when(n % 90 == 3, F.array(n + 6)).when(n % 3 == 0, F.array(n - 3, n - 7)).otherwise(F.array(n - 3))
    retries = F.get_json_object("props", "$.k").cast("long") % 8
    rows = t.read("events").select("event_id", needs.alias("depends_on"), retries.alias("retry_count"), F.lit(6).alias("max_retries"), (F.col("event_type") == "error").alias("failed"))
    return dependencies.settled(rows)


# Code, configuration and LaTeX made of the tables' rows.


def _code(t: Tables) -> DataFrame:
    """A Python file for each nation: an import of another, one or two functions, a class."""
    n = F.col("n_nationkey")
    text = F.concat(
        F.lit("from pkg.m"), (n * 7 % 25).cast("string"), F.lit(" import x\nimport os\n\n\ndef f"), n.cast("string"), F.lit('(a, *b):\n    """Gives '), F.col("n_name"), F.lit('. Always."""\n    return f'), (n * 3 % 25).cast("string"), F.lit("(a)\n"),
        F.when(n % 2 == 0, F.lit("\n\n@cached\ndef _own():\n    pass\n")).otherwise(F.lit("")), F.lit("\n\nclass K"), n.cast("string"), F.lit("(Base):\n    def m(self):\n        return 1\n"),
    )
    return t.read("nation").select("n_nationkey", F.concat(F.lit("pkg/m"), n.cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


@query("select 'pkg_m' || n_nationkey || '.py' src, 'pkg_m' || (n_nationkey * 7 % 25) || '.py' dst, 'imports' kind from nation where n_nationkey * 7 % 25 in (select n_nationkey from nation)")
def import_edges_of_files(t: Tables) -> DataFrame:
    code = _code(t)
    lines = code.select("path", F.explode(F.filter(F.split("text", "\n"), lambda x: x.startswith("from ") | x.startswith("import "))).alias("statement"))
    return graph.import_edges(lines, code.select("path")).select("src", "dst", "kind")


@query(
    """select 'pkg_m' || n_nationkey || '.py' src, 'pkg_m' || (n_nationkey * 3 % 25) || '.py' dst, 'f' || (n_nationkey * 3 % 25) name from nation where n_nationkey * 3 % 25 <> n_nationkey and n_nationkey * 3 % 25 in (select n_nationkey from nation)"""
)
def reference_edges_of_files(t: Tables) -> DataFrame:
    found = symbols.structure(_code(t)).where("kind = 'function'").groupBy("path").agg(F.collect_list("name").alias("functions"))
    return graph.reference_edges(_code(t).join(found, "path")).select("src", "dst", "name")


@query(
    """select path, kind, name, first_line, last_line from (select 'pkg/m' || n_nationkey || '.py' path, unnest([{'kind': 'function', 'name': 'f' || n_nationkey, 'first_line': 5, 'last_line': 7}, {'kind': 'class', 'name': 'K' || n_nationkey, 'first_line': case when n_nationkey % 2 = 0 then 15 else 10 end, 'last_line': case when n_nationkey % 2 = 0 then 17 else 12 end}]
    || case when n_nationkey % 2 = 0 then [{'kind': 'function', 'name': '_own', 'first_line': 11, 'last_line': 12}] else [] end, recursive := true) from nation)"""
)
def code_structure(t: Tables) -> DataFrame:
    return symbols.structure(_code(t)).select("path", "kind", "name", F.col("first").alias("first_line"), F.col("last").alias("last_line"))


@query(
    """select path, kind, name, parameters, decorators, bases, docstring from (select 'pkg/m' || n_nationkey || '.py' path, unnest([{'kind': 'function', 'name': 'f' || n_nationkey, 'parameters': 'a,b', 'decorators': '', 'bases': '', 'docstring': 'Gives ' || n_name || '. Always.'},
    {'kind': 'class', 'name': 'K' || n_nationkey, 'parameters': '', 'decorators': '', 'bases': 'Base', 'docstring': null}, {'kind': 'function', 'name': 'm', 'parameters': 'self', 'decorators': '', 'bases': '', 'docstring': null}]
    || case when n_nationkey % 2 = 0 then [{'kind': 'function', 'name': '_own', 'parameters': '', 'decorators': 'cached', 'bases': '', 'docstring': null}] else [] end, recursive := true) from nation)"""
)
def code_details(t: Tables) -> DataFrame:
    rows = symbols.details(_code(t))
    return rows.select("path", "kind", "name", *(F.array_join(c, ",").alias(c) for c in ("parameters", "decorators", "bases")), "docstring")


@query(
    """select 'pkg/m' || n_nationkey || '.py' path, case when n_nationkey % 2 = 0 then 18 else 13 end lines, 2 imports, case when n_nationkey % 2 = 0 then 3 else 2 end functions, 1 classes, 'Gives ' || n_name summary from nation"""
)
def code_heuristics_of_files(t: Tables) -> DataFrame:
    return _code(t).select("path", texts.code_counts(F.col("text")).alias("c"), texts.first_docstring(F.col("text")).alias("summary")).select("path", "c.*", "summary")


@query("select n_nationkey, n_nationkey % 4 + case when n_nationkey % 5 = 0 then 0 else 1 end keys, case when n_nationkey % 5 = 0 then n_nationkey % 4 else n_nationkey % 4 + 1 end depth, n_nationkey % 7 <> 6 valid from nation where n_nationkey % 7 <> 6 union all select n_nationkey, 0, 0, false from nation where n_nationkey % 7 = 6")
def config_metrics(t: Tables) -> DataFrame:
    """Keys and nesting of JSON texts; what is no JSON counts as not valid."""
    n = F.col("n_nationkey")
    inner = F.when(n % 5 == 0, F.lit("1")).otherwise(F.concat(F.lit('{"name": "'), "n_name", F.lit('"}')))
    text = F.concat(F.repeat(F.lit('{"k": '), (n % 4).cast("int")), inner, F.repeat(F.lit("}"), (n % 4).cast("int")), F.when(n % 7 == 6, F.lit(",")).otherwise(F.lit("")))
    rows = symbols.config_metrics(t.read("nation").select(n.cast("string").alias("path"), text.alias("text")))
    return rows.select(F.col("path").cast("int").alias("n_nationkey"), "keys", "depth", "valid")


@query(
    """select doc_id, lang || ',' || source citations, 'x_{' || doc_id || '} = y|a+' || lang equations, '1:' || source || '|2:' || lang sections, 'Rows of ' || source captions, 'eq:' || doc_id || ',tab:' || source labels from documents where lang is not null and source is not null"""
)
def latex_of_documents(t: Tables) -> DataFrame:
    c = lambda x: F.col(x).cast("string")
    text = F.concat(
        F.lit("\\section{"), c("source"), F.lit("} See \\cite{"), c("lang"), F.lit("} and \\citep{"), c("source"), F.lit(", "), c("lang"), F.lit("}. \\begin{equation} x_{"), c("doc_id"), F.lit("} = y \\end{equation} \\label{eq:"), c("doc_id"),
        F.lit("} $a+"), c("lang"), F.lit("$ \\subsection{"), c("lang"), F.lit("} \\begin{table} \\caption{Rows of "), c("source"), F.lit("} \\label{tab:"), c("source"), F.lit("} \\end{table}"),
    )
    rows = t.read("documents").where("lang is not null and source is not null").select("doc_id", text.alias("x"))
    x = F.col("x")
    titles = F.array_join(F.transform(texts.sections(x), lambda s: F.concat_ws(":", s["level"], s["title"])), "|")
    labels = F.array_join(F.regexp_extract_all(x, F.lit(r"\\label\{([^}]*)\}"), F.lit(1)), ",")
    return rows.select("doc_id", F.array_join(texts.citations(x), ",").alias("citations"), F.array_join(texts.equations(x), "|").alias("equations"), titles.alias("sections"), F.array_join(texts.table_captions(x), "|").alias("captions"), labels.alias("labels"))


@query("select doc_id, case doc_id % 4 when 2 then '' else lang || '|' || source end names from documents where lang is not null and source is not null")
def name_lists(t: Tables) -> DataFrame:
    n = F.col("doc_id") % 4
    raw = F.when(n == 0, F.concat(F.lit('["'), "lang", F.lit('","'), "source", F.lit('"]'))).when(n == 1, F.concat("lang", F.lit(", '"), "source", F.lit("'"))).when(n == 2, "").otherwise(F.concat(F.lit("["), "lang", F.lit(", "), "source", F.lit("]")))
    return t.read("documents").where("lang is not null and source is not null").select("doc_id", F.array_join(texts.names_list(raw), "|").alias("names"))


@query(
    """with recursive e as (select user_id, (epoch_us(ts) // 1000000)::bigint "at", row_number() over (partition by user_id order by ts, event_id) n from events),
    r as (select user_id, n, "at", true kept, "at" "last" from e where n = 1 union all select e.user_id, e.n, e."at", e."at" - r."last" >= 7200, case when e."at" - r."last" >= 7200 then e."at" else r."last" end from r join e on e.user_id = r.user_id and e.n = r.n + 1)
    select user_id, count(*) filter (kept) kept, max("at") filter (kept) "last" from r group by user_id"""
)
def spaced_events(t: Tables) -> DataFrame:
    """Of each user's events those at least two hours after the last one kept."""
    start = EPOCH - 86400
    rows = t.read("events").groupBy("user_id").agg(F.sort_array(F.collect_list((F.unix_timestamp(F.col("ts").cast("timestamp")) - start).cast("int"))).alias("at"))
    kept = memory.spaced(F.col("at"), 7200)
    return rows.select("user_id", F.size(kept).cast("long").alias("kept"), (F.array_max(kept).cast("long") + start).alias("last"))


@query("select distinct src, dst, kind from (select from_id src, to_id dst, kind from relationships union all select from_id, to_id, 'seen' from relationships where strength > 0.5)", "relationships")
def keyed_edges(t: Tables) -> DataFrame:
    """Edges written twice are kept once; edges of other kinds between the same ends are others."""
    own = t.relationships.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "kind", "strength")
    rows = own.unionByName(own.where("strength > 0.5").withColumn("kind", F.lit("seen")))
    return sinks.keyed_edges(rows.unionByName(rows)).select("src", "dst", "kind")


@query("select count(*) files, sum(octet_length(encode(html)))::bigint bytes from (select html from pages where html is not null)")
def written_files(t: Tables) -> DataFrame:
    """Pages written as files of their own, one a page, and read again as files."""
    at = f"{shared_folder(t.spark)}/memgrid-files-{uuid.uuid4().hex}"
    rows = t.read("pages").where("html is not null").select(F.concat(F.lit("p"), "page_id").alias("name"), "html")
    sinks.write_texts(rows.select("name", F.col("html").alias("text")), at)
    found = files.files(t.spark, at, "*.txt")
    # each file ends with a zero byte
    return found.agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("length") - 1).alias("bytes"))


@query(
    """select 'p' || page_id || '.pdf' path, '--- Page 1 ---' || chr(10) || 'page ' || page_id || chr(10) || chr(10) || '--- Page 3 ---' || chr(10) || 'last of ' || page_id "text" from pages where page_id % 5 <> 0"""
)
def marked_pages(t: Tables) -> DataFrame:
    """Pages of PDF files with their numbers; pages without text are left out, and so are files that are no PDF."""
    n = F.col("page_id").cast("string")
    head = F.when(F.col("page_id") % 5 == 0, "no pdf").otherwise("%PDF-1.4 ")
    text = F.concat(head, F.lit("/Type /Page BT (page "), n, F.lit(") Tj ET /Type /Page BT ( ) Tj ET /Type /Page BT (last) Tj (of "), n, F.lit(") Tj ET"))
    return files.marked(files.pages(t.read("pages").select(F.concat(F.lit("p"), n, F.lit(".pdf")).alias("path"), F.encode(text, "UTF-8").alias("content"))))


# Features and training.


@query("select i.n node, l.quality label from labels l join (select vec_id, row_number() over (order by vec_id) - 1 n from embeddings) i on i.vec_id = l.doc_id")
def indexed_pairs(t: Tables) -> DataFrame:
    """Training rows by the index of their node; those without one are left out."""
    index = dense_index(t.embeddings.select("vec_id"), "vec_id")
    return t.read("labels").join(index.withColumnRenamed("vec_id", "doc_id"), "doc_id").select(F.col("n").alias("node"), F.col("quality").alias("label"))


@query(
    """select doc_id, other, label from (select a.doc_id, b.doc_id other, 1 label from documents a join documents b on b.source = a.source and b.doc_id = a.doc_id + 20
    union all select a.doc_id, b.doc_id, 0 from documents a join documents b on b.doc_id = a.doc_id + 1 where b.source <> a.source)"""
)
def training_union(t: Tables) -> DataFrame:
    """Positives of one source and negatives of another, in one table."""
    d = t.read("documents").select("doc_id", "source")
    other = lambda step: d.select(F.col("doc_id").alias("other"), (F.col("doc_id") - step).alias("doc_id"), F.col("source").alias("s"))
    good = d.join(other(20), "doc_id").where("s = source").select("doc_id", "other", F.lit(1).alias("label"))
    bad = d.join(other(1), "doc_id").where("s <> source").select("doc_id", "other", F.lit(0).alias("label"))
    return good.unionByName(bad)


@query(
    """with w as (select doc_id, ('0x' || substr(md5(unnest(list_filter(regexp_split_to_array(lower(coalesce("text", '')), '\\s+'), lambda w: w <> ''))), 1, 8))::bigint % 16 pos from documents),
    c as (select doc_id, pos, count(*) n from w group by all) select doc_id, pos, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) "value" from c"""
)
def hashed_embeddings(t: Tables) -> DataFrame:
    """The hashing embedder over whole documents, places that aren't zero."""
    rows = embed.hashed_places(spread(t.read("documents").select("doc_id", "text")), "doc_id", "text", 16)
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def graph_model() -> dict:
    """Fixed layers of two kinds of edges, as a trained model would give them."""
    made = lambda n, a, b: np.round(np.sin(np.arange(a * b) + n), 3).reshape(a, b)
    layers = {kind: [(made(k, 4, 64), made(k + 1, 4, 64), made(k + 2, 4, 1)[:, 0]), (made(k + 3, 3, 4), made(k + 4, 3, 4), made(k + 5, 3, 1)[:, 0])] for k, kind in enumerate(("relates_to", "conflicts_with"))}
    return {"layers": layers, "attention": {"relates_to": 1.0, "conflicts_with": 0.5}, "project": made(9, 3, 64)}


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    number = lambda c: F.substring_index(c, "_", -1).cast("long")
    edges = t.relationships.select(number("from_id").alias("src"), number("to_id").alias("dst"), "kind")
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), edges


@query()
def graph_embeddings(t: Tables) -> DataFrame:
    """Two layers for each of two kinds of edges, combined by attention, with norm one."""
    features, edges = _graph(t)
    return learning.embedded(features, edges, **graph_model()).select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query()
def new_node_embeddings(t: Tables) -> DataFrame:
    """Embeddings of the vertices whose id is divisible by 20, from their neighbourhood alone."""
    features, edges = _graph(t)
    new = features.where("id % 20 = 0")
    return learning.embedded_new(new, edges, features, **graph_model()).select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))
