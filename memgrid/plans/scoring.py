"""Queries over scores, text, code, graph features and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, texts
from ..functions.vectors import cosine
from ..operators import graph, learning
from ..streaming import streams
from ..sources.stage import spread
from .registry import query
from .tables import Tables

# Scores of pairs.

_LEGS = """case when w_out > 0 and r_encode > 0 and h_out > 0 and t_out > 0 then w_out * r_encode * h_out / t_out else 0 end out_leg,
    case when w_in > 0 and r_decode > 0 and h_in > 0 and t_in > 0 then w_in * r_decode * h_in / t_in else 0 end in_leg"""


def _legs(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.withColumns({"out_leg": scores.bottleneck(c("w_out"), c("r_encode"), c("h_out"), c("t_out")), "in_leg": scores.bottleneck(c("w_in"), c("r_decode"), c("h_in"), c("t_in"))})


@query(
    f"""with l as (select *, {_LEGS} from pair_inputs), m as (select *, case when out_leg > 0 and in_leg > 0 then 2.0 * out_leg * in_leg / (out_leg + in_leg) else 0 end mean from l)
    select l_orderkey, l_linenumber, out_leg, in_leg, round(case when mean > 0 then mean * pow(context, alpha) * 0.9 else 0 end, 6) pair, case when mean <= 0 then 'bottleneck' end gate from m""",
    "pair_inputs",
)
def pair_score(t: Tables) -> DataFrame:
    rows = _legs(t.pair_inputs)
    s = scores.pair_score(F.col("out_leg"), F.col("in_leg"), F.col("context"), F.lit(0.9), F.col("alpha"))
    return rows.select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.out_leg", "s.in_leg", F.round("s.pair", 6).alias("pair"), "s.gate")


@query(
    f"""with l as (select *, {_LEGS} from pair_inputs), m as (select *, case when out_leg > 0 and in_leg > 0 then 2.0 * out_leg * in_leg / (out_leg + in_leg) else 0 end mean from l)
    select l_orderkey, round(sum(case when mean > 0 then pow(mean * context, alpha) * 0.9 else 0 end), 4) pair from m group by l_orderkey""",
    "pair_inputs",
)
def pair_score_monolithic(t: Tables) -> DataFrame:
    s = scores.pair_score(F.col("out_leg"), F.col("in_leg"), F.col("context"), F.lit(0.9), F.col("alpha"), True)
    return _legs(t.pair_inputs).select("l_orderkey", s["pair"].alias("pair")).groupBy("l_orderkey").agg(F.round(F.sum("pair"), 4).alias("pair"))


@query(
    """select l_orderkey, l_linenumber, round(case when w_out > 0 and r_encode > 0 and h_out > 0 and context > 0 then w_out * r_encode * h_out / t_out * pow(context, alpha) else 0 end, 6) efficiency,
    round(case when w_out > 0 and r_encode > 0 and h_out > 0 and context > 0 then w_out * r_encode * h_out * pow(context, alpha) else 0 end, 6) capability, not (w_out > 0 and r_encode > 0 and h_out > 0 and context > 0) zero_gate from pair_inputs""",
    "pair_inputs",
)
def single_score(t: Tables) -> DataFrame:
    c = F.col
    s = scores.single_score(c("w_out"), c("r_encode"), c("h_out"), c("t_out"), c("context"), c("alpha"))
    return t.pair_inputs.select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", F.round("s.efficiency", 6).alias("efficiency"), F.round("s.capability", 6).alias("capability"), "s.zero_gate")


@query(
    "select l_orderkey, l_linenumber, round(case when w_out > 0 and r_encode > 0 and h_out > 0 and context > 0 then w_out * r_encode * h_out / t_out * pow(context, alpha - 1) else 0 end, 6) amplification from pair_inputs",
    "pair_inputs",
)
def amplification(t: Tables) -> DataFrame:
    c = F.col
    s = scores.amplification(c("w_out"), c("r_encode"), c("h_out"), c("t_out"), c("context"), c("alpha"))
    return t.pair_inputs.select("l_orderkey", "l_linenumber", F.round(s, 6).alias("amplification"))


@query("select event_id, round(case when label = 'error' or duration_ms < 0 then 0 else k / 100.0 * 0.5 * 2.0 / (1 + duration_ms) * pow(0.8, 1.5) end, 6) score from spans", "spans")
def event_score(t: Tables) -> DataFrame:
    value = F.col("k") / 100.0 * 0.5 * 2.0 / (1 + F.col("duration_ms")) * F.pow(F.lit(0.8), F.lit(1.5))
    return t.spans.select("event_id", F.round(F.when((F.col("label") == "error") | (F.col("duration_ms") < 0), 0.0).otherwise(value), 6).alias("score"))


@query("select doc_id, round(exp(-age / 30), 6) recency, round(greatest(0, 1 - age / 30), 6) freshness from (select doc_id, (1704067200 + 5000 * 3600 - created_at_unix) / 86400.0::double age from observations)", "observations")
def recency_scores(t: Tables) -> DataFrame:
    age = (F.lit(1704067200 + 5000 * 3600) - F.col("created_at_unix")) / 86400.0
    return t.observations.select("doc_id", F.round(scores.recency(age), 6).alias("recency"), F.round(scores.freshness(age), 6).alias("freshness"))


# Text.


@query("select doc_id, chunk_index, start_token, end_token, total_tokens, chunk from doc_chunks", "doc_chunks")
def chunk_windows(t: Tables) -> DataFrame:
    from ..operators.chunks import windows

    return windows(spread(t.read("documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "chunk_index", "start_token", "end_token", "total_tokens", "chunk")


@query(
    """with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower("text"), '\\s+'), lambda w: w <> '')) word from documents), c as (select word, count(*) n from w group by word), n as (select sum(n) total from c)
    select doc_id, round(avg(-ln(c.n / total)), 6) surprise, round(var_pop(-ln(c.n / total)), 4) variance, case when avg(-ln(c.n / total)) < 0.5 then 'well_structured' when avg(-ln(c.n / total)) > 1.5 then 'mixed_concerns' else 'moderate' end kind from w join c using (word), n group by doc_id"""
)
def unigram_surprise(t: Tables) -> DataFrame:
    from ..operators.surprise import surprising

    rows = surprising(spread(t.read("documents").select("doc_id", F.lower("text").alias("text"))), "doc_id", "text")
    kind = F.when(F.col("mean") < 0.5, "well_structured").when(F.col("mean") > 1.5, "mixed_concerns").otherwise("moderate")
    return rows.select("doc_id", F.round("mean", 6).alias("surprise"), F.round(F.col("square") - F.col("mean") * F.col("mean"), 4).alias("variance"), kind.alias("kind"))


@query("select path, starts_with(array_to_string((string_split(path, '/'))[-2:], '/'), 'de/') ignored from repo_docs", "repo_docs")
def ignore_patterns(t: Tables) -> DataFrame:
    from ..sources.files import ignored

    return t.repo_docs.select("path", ignored(F.substring_index("path", "/", -2), ["# comment", "/de/", ""]).alias("ignored"))


@query("select 'dir:' || coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') src, regexp_replace(regexp_replace(regexp_replace(path, '[/ ]', '_', 'g'), '[^\\p{L}\\p{N}_.:@()+-]', '', 'g'), '^[._-]+|[._-]+$', '', 'g') dst, 'contains' kind, 1.0::double weight from repo_docs", "repo_docs")
def contains_edges(t: Tables) -> DataFrame:
    return graph.contains_edges(t.repo_docs.select("path"))


@query("select n_name, 'Hello ' || n_name || ' of {unknown} ' || n_regionkey line from nation")
def templates(t: Tables) -> DataFrame:
    return t.read("nation").select("n_name", texts.rendered("Hello {name} of {unknown} {region}", name=F.col("n_name"), region=F.col("n_regionkey")).alias("line"))


@query("select doc_id, length(content) // 4 tokens, case when length(content) // 4 > 16000 then 1 when length(content) // 4 > 8000 then 2 when length(content) // 4 > 4000 then 4 else 8 end batch from observations", "observations")
def token_estimates(t: Tables) -> DataFrame:
    n = F.floor(F.length("content") / 4).cast("long")
    return t.observations.select("doc_id", n.alias("tokens"), F.when(n > 16000, 1).when(n > 8000, 2).when(n > 4000, 4).otherwise(8).alias("batch"))


@query("select sha256(string_agg(n_name, ',' order by n_name)) digest from nation")
def symbol_digest(t: Tables) -> DataFrame:
    return t.read("nation").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("n_name")), ","), 256).alias("digest"))


# Graph features.


@query(
    """with f as (select vec_id, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) - 1 pos from embeddings)
    select e.dst id, f.pos, round(avg(f.x), 6) + 0.0 "value" from knn_edges e join f on f.vec_id = e.src group by e.dst, f.pos""",
    "knn_edges",
)
def neighbour_mean(t: Tables) -> DataFrame:
    features = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return learning.neighbour_mean(t.knn_edges, features).select("id", F.col("pos").cast("long").alias("pos"), (F.round("value", 6) + 0.0).alias("value"))


_ROOT, _SIDE, _BIAS = (np.round(np.sin(np.arange(n) + k), 3) for n, k in ((128, 0), (128, 5), (2, 9)))


@query(
    f"""with f as (select vec_id id, embedding::double[] v from embeddings),
    u as (select e.dst id, p, avg(f.v[p]) m from knn_edges e join f on f.id = e.src, (select unnest(range(1, 65)) p) group by e.dst, p), m as (select id, list(m order by p) m from u group by id)
    select f.id, round(greatest(0, list_dot_product(v, {_ROOT[:64].tolist()}::double[]) + list_dot_product(coalesce(m, list_resize([]::double[], 64, 0.0::double)), {_SIDE[:64].tolist()}::double[]) + {_BIAS[0]}), 6) a,
    round(greatest(0, list_dot_product(v, {_ROOT[64:].tolist()}::double[]) + list_dot_product(coalesce(m, list_resize([]::double[], 64, 0.0::double)), {_SIDE[64:].tolist()}::double[]) + {_BIAS[1]}), 6) b from f left join m using (id)""",
    "knn_edges",
)
def mean_layer(t: Tables) -> DataFrame:
    own = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    means = learning.gathered(learning.neighbour_mean(t.knn_edges, own))
    out = learning.layer(own, means, _ROOT.reshape(2, 64), _SIDE.reshape(2, 64), _BIAS)
    return out.select("id", F.round(F.get("v", F.lit(0)), 6).alias("a"), F.round(F.get("v", F.lit(1)), 6).alias("b"))


@query(
    """select round(avg(case when label = 1 then 1 - sim else greatest(0, sim - 0.5) end), 6) loss, round(avg(case when (sim > 0.5)::int = label then 1 else 0 end), 6) accuracy,
    round(coalesce(avg(sim) filter (label = 1), 0), 6) positive, round(coalesce(avg(sim) filter (label = 0), 0), 6) negative from training_pairs""",
    "training_pairs",
)
def contrastive_loss(t: Tables) -> DataFrame:
    return learning.contrastive(t.training_pairs)


@query("select kind, round(exp(n / 1000.0) / sum(exp(n / 1000.0)) over (), 6) share from (select kind, count(*) n from relationships group by kind)", "relationships")
def edge_type_softmax(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    rows = t.relationships.groupBy("kind").agg(F.exp(F.count(F.lit(1)) / 1000.0).alias("e"))
    return rows.select("kind", F.round(F.col("e") / F.sum("e").over(W.partitionBy()), 6).alias("share"))


@query(
    """select a.vec_id, round(max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) closest from embeddings a, (select embedding from embeddings where vec_id < 3) b group by a.vec_id"""
)
def closest_of_set(t: Tables) -> DataFrame:
    some = t.embeddings.where("vec_id < 3").agg(F.collect_list("embedding").alias("set"))
    rows = t.embeddings.crossJoin(F.broadcast(some))
    return rows.select("vec_id", F.round(F.array_max(F.transform("set", lambda v: cosine(v, F.col("embedding")))), 6).alias("closest"))


# Streams.


@query("select \"key\", op, payload, seq_no from (select *, row_number() over (partition by \"key\" order by seq_no desc) n from changes) where n = 1 and op not like 'delete%'", "changes")
def latest_state_from_events(t: Tables) -> DataFrame:
    return streams.latest(t.changes)


@query("select \"key\", op, payload, seq_no from (select *, row_number() over (partition by \"key\" order by seq_no desc) n from changes) where n = 1 and op not like 'delete%'", "changes")
def change_stream(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/events.parquet"
    schema = t.read("events").schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(t, path) else f"{t.sf_dir}/events*.parquet")
    op = F.when(F.col("event_type") == "error", "delete_node").otherwise("upsert_node")
    return streams.applied(rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq_no"), op.alias("op"), F.col("value").alias("payload")))


def _is_folder(t: Tables, path: str) -> bool:
    jvm = t.spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(t.spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()


_SESSIONS = """select user_id, epoch_us(min(ts)) // 1000000 started, epoch_us(max(ts)) // 1000000 + 7200 ended, count(*) n from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) g from (
    select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hours then 0 else 1 end new from events)) group by user_id, g"""


@query(_SESSIONS)
def session_activity(t: Tables) -> DataFrame:
    rows = streams.activity(t.read("events").select("user_id", F.col("ts").cast("timestamp").alias("at")))
    return rows.select("user_id", F.unix_timestamp("start").alias("started"), F.unix_timestamp("end").alias("ended"), "n")


@query(_SESSIONS)
def session_activity_stream(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/events.parquet"
    rows = t.spark.readStream.schema(t.read("events").schema).parquet(path if _is_folder(t, path) else f"{t.sf_dir}/events*.parquet")
    out = streams.drained(streams.activity(rows.select("user_id", F.col("ts").cast("timestamp").alias("at"))), "sessions", "complete")
    return out.select("user_id", F.unix_timestamp("start").alias("started"), F.unix_timestamp("end").alias("ended"), "n")


@query("select epoch_us(date_trunc('day', ts)) // 1000000 started, event_type label, count(*) n, round(sum(\"value\"), 4) total from events group by all")
def daily_rates(t: Tables) -> DataFrame:
    rows = streams.rates(t.read("events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("label"), "value"))
    return rows.select(F.unix_timestamp("start").alias("started"), "label", "n", F.round("total", 4).alias("total"))
