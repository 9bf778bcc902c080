"""LaTeX around the texts of documents, and retrieval over three collections with their payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embed
from ..operators import graph, latex, memory, recall
from ..sources.stage import saved
from .records import AS_OF
from .registry import query
from .retrieval import _EDGES, _MEMORY, _SEEDS, _memory_hop, asked
from .tables import EPOCH, Tables

_PAPER = r"""p as (select doc_id, source, lang, left("text", 300) pre, '\begin{table}[h] \caption{Of {' || source || '}}\label{tab:' || doc_id || '} \begin{tabular}[t]{l@{ }r} a & ' || lang || ' \\ \end{tabular}'
    || case when doc_id % 3 = 0 then ' \begin{table*} x \begin{center} y \end{center} \end{table*}' else '' end || ' \end{table}' as tab,
    ' \section{On ' || source || '} ' || case when doc_id % 5 = 0 then '\begin{table} \end{tabular} ' else '' end || substr("text", 301, 200) post from documents where lang is not null and source is not null and "text" is not null)"""


def _papers(t: Tables) -> DataFrame:
    """Documents with a table in them, in every third another one in it, and in every fifth marks that don't match."""
    i = F.col("doc_id")
    nested = F.when(i % 3 == 0, F.lit(r" \begin{table*} x \begin{center} y \end{center} \end{table*}")).otherwise(F.lit(""))
    table = F.concat(F.lit(r"\begin{table}[h] \caption{Of {"), "source", F.lit(r"}}\label{tab:"), i, F.lit(r"} \begin{tabular}[t]{l@{ }r} a & "), "lang", F.lit(r" \\ \end{tabular}"), nested, F.lit(r" \end{table}"))
    odd = F.when(i % 5 == 0, F.lit(r"\begin{table} \end{tabular} ")).otherwise(F.lit(""))
    text = F.concat(F.left("text", F.lit(300)), table, F.lit(r" \section{On "), "source", F.lit("} "), odd, F.col("text").substr(301, 200))
    return t.read("documents").select("doc_id", text.alias("x")).where("x is not null")


@query(
    "with "
    + _PAPER
    + r""" select doc_id, 1 depth, length(pre) start_at, length(pre) + length(tab) end_at, 'Of {' || source || '}' caption, 'tab:' || doc_id as "label", 'l@{ }r' column_spec, 'a & ' || lang || ' \\' tabular from p
    union all select doc_id, 2, length(pre) + length(tab) - 71, length(pre) + length(tab) - 12, null, null, null, null from p where doc_id % 3 = 0"""
)
def latex_tables(t: Tables) -> DataFrame:
    """Tables of documents with their places, captions, labels, column specifications and bodies."""
    rows = latex.tables(_papers(t), "doc_id", "x")
    return rows.select("doc_id", F.col("depth").cast("int").alias("depth"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), "caption", "label", "column_spec", "tabular")


@query("with " + _PAPER + """ select doc_id, 'section' as "level", 'On ' || source title, length(pre) + length(tab) + 1 start_at from p""")
def latex_sections(t: Tables) -> DataFrame:
    return latex.sections(_papers(t), "doc_id", "x").select("doc_id", "level", "title", F.col("start").alias("start_at"))


_MENTIONED = f"""ents as (select 'entities/' || source || '_' || lang id, source || ' ' || lang as "name", count(*) n, max({EPOCH} + doc_id * 3600) seen from documents where source is not null and lang is not null group by source, lang),
    allv as (select id, collection, embedding, created_at_unix from vertices union all select id, 'entities', null, seen from ents)"""
_ALL_EDGES = _EDGES + " union all select 'observations/obs_' || doc_id, 'entities/' || source || '_' || lang, 0.9, 1 from documents where source is not null and lang is not null"


@query(
    "with "
    + _MENTIONED
    + ", "
    + _SEEDS.format("pattern, ", _ALL_EDGES)
    + _memory_hop(0).replace("vertices v", "allv v")
    + _memory_hop(1).replace("vertices v", "allv v")
    + """, u as (select id, score, rank, pos from (select unnest(path) id, generate_subscripts(path, 1) pos, score, rank from b2) qualify row_number() over (partition by id order by rank, pos) = 1),
    best as (select *, row_number() over (order by score desc, rank, pos) place from u qualify place <= 12)
    select b.id, b.score, b.place, v.collection, coalesce(left(o.content, 80), e.name) title, coalesce(r.source_count, e.n) n, o.memory_type kind, coalesce(o.status, r.status) status
    from best b join allv v on v.id = b.id left join observations o on o.id = b.id left join reflections r on r.id = b.id left join ents e on e.id = b.id""",
    "relationships",
    "vertices",
)
def retrieve_payloads(t: Tables) -> DataFrame:
    """The beam over observations, reflections and entities; the best vertices of all three, each with its collection's payload."""
    d = t.read("documents").where("source is not null and lang is not null")
    key = F.concat(F.lit("entities/"), "source", F.lit("_"), "lang")
    named = d.groupBy(key.alias("id"), F.concat_ws(" ", "source", "lang").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max(F.lit(EPOCH) + F.col("doc_id") * 3600).alias("seen"))
    own = t.vertices.select("id", "collection", "embedding", "created_at_unix")
    vertices = saved(own.unionByName(named.select("id", F.lit("entities").alias("collection"), F.lit(None).cast("array<double>").alias("embedding"), F.col("seen").alias("created_at_unix"))))
    said = d.select(F.concat(F.lit("observations/obs_"), "doc_id").alias("src"), key.alias("dst"), F.lit(0.9).alias("weight"), F.lit(1).alias("pattern"))
    edges = graph.memory_edges(t.relationships, t.reflections).unionByName(said)
    queries = asked(t).select(F.lit(1).alias("query_id"), "q")
    first = recall.seeds(vertices.where("collection = 'observations'"), queries, -1.0)
    beam = graph.memory_beam(first, edges, vertices, queries, as_of=float(AS_OF))
    rows = recall.best(graph.reached(beam).join(vertices.select("id", "collection"), "id"), 12)
    payloads = {
        "observations": t.observations.select("id", F.left("content", F.lit(80)).alias("title"), F.lit(None).cast("long").alias("n"), F.col("memory_type").alias("kind"), "status"),
        "reflections": t.reflections.select("id", F.lit(None).cast("string").alias("title"), F.col("source_count").alias("n"), F.lit(None).cast("string").alias("kind"), "status"),
        "entities": named.select("id", F.col("name").alias("title"), "n", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("status")),
    }
    return recall.with_payloads(rows, payloads).select("id", "score", "place", "collection", "title", "n", "kind", "status")


_CAPPED = "(select count(*) from s{0}) > 8"
_COVERED = "coalesce((select max(score) from t{0}), 0) < 0.3"


@query(
    _MEMORY
    + f""", h as (select {_CAPPED.format(0)} m0, {_COVERED.format(0)} c0, {_CAPPED.format(1)} m1, {_COVERED.format(1)} c1)
    select 1 query_id, array_to_string(list_filter([case when m0 then 'cap_exceeded_hop_0' end, case when c0 then 'coverage_reached' end, case when m1 and not c0 then 'cap_exceeded_hop_1' end, case when c1 and not c0 then 'coverage_reached' end], lambda x: x is not null), ',') reasons,
    (select count(*) from b2) paths from h union all select 2, 'empty_seeds', 0""",
    "relationships",
    "vertices",
)
def beam_reasons(t: Tables) -> DataFrame:
    """Why two queries' beams are as they are: one that finds seeds, and one that finds none."""
    vertices = t.vertices.select("id", "collection", "embedding", "created_at_unix")
    one = asked(t).select(F.lit(1).alias("query_id"), "q")
    first = recall.seeds(vertices.where("collection = 'observations'"), one, -1.0)
    beams = graph.memory_beams(first, graph.memory_edges(t.relationships, t.reflections), vertices, one, as_of=float(AS_OF))
    both = one.unionByName(one.withColumn("query_id", F.lit(2)))
    return graph.reasons(beams, both).select("query_id", F.array_join("reasons", ",").alias("reasons"), F.col("paths").cast("long").alias("paths"))


@query(
    f"""with recent as (select * from observations qualify row_number() over (partition by session_id order by created_at_unix desc, "key") <= 100),
    rest as (select session_id, "key", id, created_at_unix, content, memory_type, tags, unnest(tags) tag from recent where id not in (select unnest(consolidates) from reflections where status = 'active')),
    numbered as (select *, row_number() over (partition by session_id, tag order by created_at_unix desc, "key") n, count(*) over (partition by session_id, tag) size from rest),
    g as (select session_id, tag, string_agg(id, ',' order by n) ids, count(*) source_count, list_sort(list_distinct(flatten(list(list_filter(tags, lambda x: x is not null))))) tags,
        round(avg(greatest(0, 1 - ({AS_OF} - created_at_unix) / 2592000.0::double)), 2) strength, string_agg('[' || n || '] ' || upper(memory_type) || ': ' || coalesce(content, '') || chr(10) || '   Tags: ' || array_to_string(list_filter(tags, lambda x: x is not null), ', '), chr(10) || chr(10) order by n) prompt
        from numbered where size >= 3 and n <= 10 and tag is not null group by session_id, tag)
    select 'ref_' || substr(sha256(session_id || '|' || tag || '|' || ids), 1, 16) "key", array_to_string(tags, ',') tags, ids consolidates, source_count, strength, len(list_filter(regexp_split_to_array(prompt, '\\s+'), lambda w: w <> '')) prompt_tokens, trim(left(prompt, 120)) content from g""",
    "observations",
    "reflections",
)
def written_reflections(t: Tables) -> DataFrame:
    """Reflections with all that they carry; the generator gives the prompt's start, the embedder hashes words."""
    found = memory.candidates(t.observations, t.reflections).where("tag is not null")
    rows = memory.reflections(found, t.observations, float(AS_OF), lambda prompt: F.left(prompt, F.lit(120)), lambda text: embed.hashed(text, 16))
    return rows.select("key", F.array_join("tags", ",").alias("tags"), F.array_join("consolidates", ",").alias("consolidates"), "source_count", "strength", "prompt_tokens", "content")
